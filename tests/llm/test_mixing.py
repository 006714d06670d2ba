import math
from collections import defaultdict

import pytest

from linemill.llm import mixing as M

SIZES = {"a": 200, "b": 60, "c": 40, None: 10}


def docs(spark):
    rows, i = [], 0
    for s, n in SIZES.items():
        for k in range(n):
            rows.append((i, s, "w " * (5 + k % 7)))
            i += 1
    rows += [(i, "a", ""), (i + 1, "b", None), (i + 2, "empty", ""), rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as n", "2 as block", "3 as copies")


@pytest.mark.parametrize(("entropy", "repetition"), [(0.95, 50.0), (0.99, 50.0), (0.99, 2.0), (0.5, 4.0)])
def test_weights_meet_the_target_and_budgets_are_kept(spark, entropy, repetition):
    rows, frame = docs(spark)
    got = M.mix(frame, entropy=entropy, repetition=repetition, block_tokens=64).collect()
    assert sorted(((r.row.doc_id, r.row.source) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    held, used, weight, copies, largest = defaultdict(int), defaultdict(int), {}, defaultdict(set), defaultdict(int)
    for r in got:
        s = r.row.source
        held[s] += r.n_tokens
        used[s] += r.n_tokens * r.copies
        weight[s] = r.weight
        copies[s].add(r.copies)
        largest[s] = max(largest[s], r.n_tokens)
    assert all(max(c) - min(c) <= 1 for c in copies.values())  # whole passes, then a part of one
    total = sum(held.values())
    shares = {s: w for s, w in weight.items() if held[s]}
    assert math.isclose(sum(shares.values()), 1, rel_tol=1e-6)
    reached = -sum(w * math.log(w) for w in shares.values()) / math.log(len(shares))
    most = max(w * total / held[s] for s, w in shares.items())
    natural = -sum(held[s] / total * math.log(held[s] / total) for s in shares) / math.log(len(shares))
    assert most <= repetition + 1e-3 and (reached >= min(entropy, 1) - 1e-4 or most >= repetition - 1e-2)
    assert natural < entropy or math.isclose(reached, natural, rel_tol=1e-6)
    for s, w in shares.items():
        assert w * total - 2 * largest[s] - 1 <= used[s] <= w * total + 1


def test_whole_keeps_every_row(spark):
    rows, frame = docs(spark)
    got = M.rows_mixed(frame, entropy=0.99, repetition=1.5, whole=True)
    assert got.columns == frame.columns
    times = defaultdict(int)
    for r in got.collect():
        times[r.doc_id] += 1
    assert set(times) == {r[0] for r in rows} and max(n for i, n in times.items() if i) <= 2
    assert M.mix(frame.limit(0)).collect() == []
    spread = M.mix(spark.range(1000).selectExpr("id as doc_id", "'s' as source", "if(id = 0, 'w', '') as text"), block_rows=50).collect()
    assert len({r.block for r in spread}) == 20 and len(spread) == 1000
    only = frame.filter("source = 'b'")
    assert {r.copies for r in M.mix(only).collect()} == {1}


@pytest.mark.parametrize("few", [True, False])
def test_matches_brute_force(spark, monkeypatch, few):
    """Blocks in the order of their hashes until the budget is met, then documents of the next one."""
    if not few:
        monkeypatch.setattr(M, "BROADCAST", 0)
        monkeypatch.setattr(M, "frequent", lambda counts, keys, total: counts.filter("m > 100"))
    _, frame = docs(spark)
    got = M.mix(frame, entropy=0.99, repetition=3.0, block_tokens=64).collect()
    keyed = {}
    hashes = frame.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, text, 0) as h", "size(filter(split(coalesce(text, ''), ' '), x -> x != '')) as n").collect()
    turns = {r.b: r.t for r in spark.range(1000).selectExpr("id as b", "xxhash64(id, 1) as t").collect()}
    for r in hashes:
        keyed.setdefault(r.source, []).append(r)
    total = sum(r.n for r in hashes)
    weight = {r.row.source: r.weight for r in got}
    want = []
    for s, rows in keyed.items():
        size = sum(r.n for r in rows)
        passes = round(min(weight[s] * total / size, 3.0), 9) if size else 1
        full, rest = int(passes), int((passes - int(passes)) * size) if size else 0
        blocks, count = {}, max(1, -(-size // 64), -(-len(rows) // (1 << 18)))
        for r in rows:
            blocks.setdefault(r.h % count, []).append(r)
        for b in sorted(blocks, key=lambda b: (turns[b], b)):
            own = sorted(blocks[b], key=lambda r: r.h)
            whole = sum(r.n for r in own) <= rest
            for r in own:
                tied = sum(x.n for x in own if x.h <= r.h)
                want.append((r.doc_id, s, b, full + int(size > 0 and rest > 0 and rest == rest and (whole or tied <= rest))))
            rest_after = rest - sum(r.n for r in own)
            rest = rest_after if whole else (0 if rest > 0 else rest)
            if not whole:
                rest = -1
    differ = {x[:3] for x in want} ^ {(r.row.doc_id, r.row.source, r.block) for r in got}
    assert not differ
    mine = {(r.row.doc_id, r.row.source): r.copies for r in got}
    wrong = [x for x in want if mine[x[0], x[1]] != x[3]]
    assert len(wrong) <= len(keyed)  # a budget may round to a token more or less


def test_no_text_moves(spark):
    _, frame = docs(spark)
    plan = M.mix(frame)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_very_long_texts(spark):
    frame = spark.createDataFrame([(1, "a", "w " * 2_000_000), (2, "b", "w")], "doc_id long, source string, text string")
    assert {r.row.doc_id: r.n_tokens for r in M.mix(frame).collect()} == {1: 2_000_000, 2: 1}
