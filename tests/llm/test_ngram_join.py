import random
import re
from itertools import combinations

import numpy as np
import pytest

from linemill.llm import components
from linemill.llm import ngram_join as J
from linemill.llm.ngram_join import ngram_components
from linemill.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(sets[x]), least.get(find(x), i) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def near(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice("abcdefgh") * rng.randrange(1, 4)
    return w


@pytest.mark.parametrize(("k", "percent", "hot", "stars", "narrow"), [(4, 85, 1 << 16, 1, 32), (5, 80, 1 << 16, 3, 2), (3, 70, 5, 1, 1), (4, 85, 7, 0, 4)])
def test_components_match_brute_force(spark, k, percent, hot, stars, narrow):
    rng = random.Random(k * percent + hot)
    rows, base = [], [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 5) for _ in range(rng.randrange(3, 120))] for _ in range(25)]
    for b in base:
        for _ in range(rng.choice([1, 2, 9])):
            rows.append(" ".join(near(rng, b, rng.choice([0, 0, 1, 1, 2, 3, 5]))))
    passage = " ".join(base[0])
    rows += [f"{passage} {' '.join(b)}" for b in base]  # a passage that many share
    rows += ["", "   ", None, "one", "ONE", "one two", "One  Two\n", "é É", "x" * 5000, " ".join(["again"] * 500), " ".join(["again"] * 400)]
    rows += rows[:20]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    docs = [(i, t) for i, t in zip(ids, rows, strict=True)]
    docs += docs[:3] + [(None, rows[0]), (None, None)]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as n_shingles", "1 as node", "2 as n")
    got = ngram_components(frame.repartition(3), k=k, percent=percent, hot=hot, stars=stars, narrow=narrow, sketch_bits=8).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs, k, percent)


@pytest.mark.parametrize(("edits", "size", "narrow"), [([0, 1, 2, 3, 4], 150, 1), ([2, 3, 5, 8], 200, 2), ([1, 9, 10], 120, 1)])
def test_dense_group_of_near_copies(spark, edits, size, narrow):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    docs = [(i, " ".join(near(rng, base, rng.choice(edits)))) for i in range(200)]
    got = ngram_components(spark.createDataFrame(docs, SCHEMA), k=4, percent=85, hot=40, narrow=narrow).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(docs, 4, 85))


def test_candidates_of_a_dense_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Edited copies of one text, most of which stay apart: rows that the joins make before a pair is checked."""
    made = []

    def told(name, on):
        before = getattr(on, name)

        def after(*args):
            rows = args[1] if on is J._Join else None
            out = before(*args)
            made.append((rows if rows is not None else out).count())
            return out

        monkeypatch.setattr(on, name, after)

    told("_candidates", J._Join)
    told("pairs", J.D)
    counts = []
    for size in (200, 800):
        rng = random.Random(1)
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows = []
        for i in range(size):
            words = list(base)
            for _ in range(3):
                words[rng.randrange(200)] = f"e{rng.randrange(10**9)}"
            rows.append((i, " ".join(words)))
        made.clear()
        got = ngram_components(spark.createDataFrame(rows, SCHEMA), k=4, percent=85).collect()
        if size == 200:
            assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4, 85))
        counts.append(sum(made))
    assert counts[1] < 2.5**2 * counts[0] and counts[1] < 60 * 800, counts  # two doublings; all pairs would be 18 times 319600


def test_deviations_lose_no_link():
    """Elements that deviations list for a partner, places and parities, against the sets themselves."""
    rng = random.Random(3)
    often = lambda x: (x % np.uint64(7)).astype(np.int64) + 2
    percent, q = 85, 185
    for _ in range(300):
        centre = {rng.randrange(2**64) for _ in range(60)}
        sets = [np.array(sorted((centre - set(rng.sample(sorted(centre), rng.randrange(12)))) | {rng.choice([rng.randrange(2**64), 5, 6, 7]) for _ in range(rng.randrange(6))}), np.uint64) for _ in range(2)]
        c = np.array(sorted(centre), np.uint64)
        (a, x), (b, y) = sorted(((J.D.deviation(s, c, percent, often), s) for s in sets), key=lambda p: p[0][0])
        both = len(np.intersect1d(x, y))
        linked = 100 * both >= percent * (len(x) + len(y) - both)
        if a[0] + b[0] <= 0:
            assert linked
        elif linked:
            lead = {int(e) for e, at in zip(a[3], a[4], strict=True) if at < a[2]}
            assert lead & {int(e) for e in b[3]}
            bits = [np.unpackbits(np.array(J.D.parities(s, c), np.int64).view(np.uint8)) for s in (x, y)]
            assert q * int((bits[0] != bits[1]).sum()) <= (100 - percent) * (len(x) + len(y))


def test_very_long_texts(spark):
    rng = random.Random(8)
    words = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(400_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-3], "x", "y", "z"])), (3, " ".join(words[::-1]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2][1] == got[1][1] == 1 and got[3][1] == 3 and got[1][0] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(6)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "links")).collect()
    met = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(tuple(r) for r in got) == sorted((x, root[x]) for x in met)


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []
    only = ngram_components(spark.createDataFrame([(3, None), (None, "")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in only), key=str) == [(3, 0, 3), (None, 0, None)]
