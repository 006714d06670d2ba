import random
import time

from linemill.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def test_patience_aligns_in_order():
    a, b = [1, 2, 3, 4, 5], [9, 2, 3, 8, 5, 1]
    assert L.patience(a, b) == [(1, 1), (2, 2), (4, 4)]
    assert L.patience([], b) == [] and L.patience(a, a) == [(i, i) for i in range(5)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = L.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def _count(line):
    return len(line.strip(" ").split(" ")) if line.strip(" ") else 0


def every_earlier(rows, min_words):
    """Each document loses every stretch of lines with enough words that any earlier document holds, over whole texts; of each row id, text, lines lost."""
    key = lambda i, t: (-(2**63) if i is None else i, t or "")
    docs = [(d, d[1].split("\n")) for d in sorted({key(*r) for r in rows}, key=lambda d: (d[0], d[1]))]
    out, held = {}, set()
    for d, x in docs:
        n = list(map(_count, x))
        gone, own = set(), set()
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if sum(n[i:j]) >= min_words:
                    own.add(tuple(x[i:j]))
                    if tuple(x[i:j]) in held:
                        gone |= set(range(i, j))
        held |= own
        out[d] = "\n".join(v for i, v in enumerate(x) if i not in gone), len(gone)
    return sorted(((i, *out[key(i, t)]) for i, t in rows), key=str)


def test_a_block_is_found_whoever_holds_its_lines_first(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten"
    rows = [(1, a), (2, f"x\n{b}"), (3, c), (4, f"start\n{a}\n\n{b}\n{c}"), (5, f"own\n{a}\n\n{b}\n{c}\nend"), (6, f"{a}\n{b}")]
    got = {r.row.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA), min_words=8).collect()}
    assert got == dict(rows) | {5: "own\nend"}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 9)))
    stock = [line() for _ in range(12)]
    passage = [line() for _ in range(6)]
    rows = []
    for i in range(80):
        lines = [rng.choice(stock) if rng.random() < 0.4 else line() for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[: rng.randrange(2, 7)]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:10])]  # copies
    rows += rows[:3] + [(None, rows[4][1]), (300, ""), (301, None), (302, "\n\n"), (None, None), (303, "long " * 20_000), (304, "long " * 20_000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as k", "1 as gone", "'y' as row")
    got = L.line_dedup(frame.repartition(3), min_words=7).collect()
    assert sorted(((r.row.doc_id, r.text, r.n_removed) for r in got), key=str) == every_earlier(rows, 7)


def test_passages_in_another_order_go_from_every_later_document(spark):
    p, q = "p1 p2 p3 p4 p5\np6 p7 p8 p9", "q1 q2 q3 q4 q5 q6 q7 q8"
    rows = [(1, f"{p}\nown one\n{q}")] + [(i, f"start {i}\n{q}\nown {i}\n{p}\nend {i}") for i in range(2, 6)]
    got = {r.row.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA), min_words=8).collect()}
    assert got == {1: rows[0][1]} | {i: f"start {i}\nown {i}\nend {i}" for i in range(2, 6)}


def test_matches_alignment_with_every_earlier_document(spark):
    rng = random.Random(5)
    stock = ["", "a", "b b", "c c c", "d d d d"]
    rows = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.9 else f"own {i}" for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = L.line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), min_words=6).collect()
    assert sorted(((r.row.doc_id, r.text, r.n_removed) for r in got), key=str) == every_earlier(rows, 6)


def test_patience_aligns_lines_that_occur_twice():
    assert L.patience([1, 7, 2, 7, 3], [8, 7, 9]) == [(1, 1)]
    assert L.patience([1, 7, 3], [8, 7, 9, 7, 4]) == [(1, 1)]
    assert L.patience([1, 7, 2, 7, 3], [8, 7, 9, 7, 4]) == [(1, 1), (3, 3)]


def test_a_doubled_passage_goes_from_later_documents(spark):
    p = "p1 p2 p3 p4 p5 p6 p7 p8"
    twice = [f"head {i}\n{p}\nown {i}\n{p}\nend {i}" for i in range(4)]
    once = [f"start {i}\n{p}\nclose {i}" for i in range(4)]
    for rows, left in (
        ([(1, twice[1]), (2, once[2]), (3, once[3])], {1: twice[1], 2: "start 2\nclose 2", 3: "start 3\nclose 3"}),
        ([(1, once[1]), (2, twice[2]), (3, twice[3])], {1: once[1], 2: "head 2\nown 2\nend 2", 3: "head 3\nown 3\nend 3"}),
    ):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert {r.row.doc_id: r.text for r in L.line_dedup(frame, min_words=8).collect()} == left
        assert {r.doc_id: r.text for r in L.rows_left(frame, min_words=8).collect()} == left


def test_words_and_line_ends_of_any_white_space(spark):
    tabs, han, thai = "\t".join("abcdefgh"), "\u6211\u4eec\u5728\u8fd9\u91cc\u770b\u4e66\uff0c\u559d\u8336", "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35\u0e0a\u0e32\u0e27"
    passage = "one two three four\n\nfive six seven eight"
    link = "https://example.org/one/long/link/of/one/word"
    rows = []
    for i, part in enumerate([tabs, han, thai, passage.replace("\n", "\r\n"), link]):
        rows += [(10 * i + 1, part), (10 * i + 2, f"own {i}\n{part}\nend {i}")]
    rows += [(35, f"own\n{passage}\t \nend"), (36, "x y\n \t\r\nz")]
    got = {r.row.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA), min_words=8).collect()}
    assert got == dict(rows) | {10 * i + 2: f"own {i}\nend {i}" for i in range(4)} | {35: "own\nend"}


def test_rows_left_keeps_columns_and_drops_emptied(spark):
    body = "one two three four five six seven\neight nine ten eleven twelve thirteen fourteen"
    rows = [(1, body, 5), (2, body, 5), (3, body + "\nfresh", 6), (4, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = L.rows_left(frame, min_words=10)
    assert got.columns == frame.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, body, 5), (3, "fresh", 5), (4, "", 0)]


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_alignments_take_everything_in_any_order():
    rng = random.Random(7)
    for n in (0, 1, 7, 60):
        earlier = rng.sample(range(1000), n)
        for later in (earlier, earlier[::-1], rng.choices(earlier, k=3 * n) if n else [], earlier[n // 2 :] + earlier[: n // 2]):
            got = L.aligned(earlier, later)
            assert sorted(y for block in got for y in block) == list(range(len(later)))
            place = {h: x for x, h in enumerate(earlier)}
            for block in got:
                assert all(p < q and place[later[p]] < place[later[q]] for p, q in zip(block, block[1:], strict=False))
    assert len(L.aligned(list(range(100)), list(range(100)))) == 1


def test_a_document_of_very_many_lines(spark):
    own = [f"line {i} of the first one" for i in range(200_000)]
    rows = [(1, "\n".join(own)), (2, "\n".join(["fresh start", *own[100_000:], *own[:100_000], "fresh end"]))]
    began = time.perf_counter()
    got = {r.row.doc_id: (r.text, r.n_removed) for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == ("fresh start\nfresh end", 200_000) and got[1][1] == 0
    assert time.perf_counter() - began < 120


def test_a_line_that_nearly_all_documents_hold(spark):
    stock = " ".join(f"s{i}" for i in range(25))
    rows = [(i, f"own {i}\n{stock}\nend {i}") for i in range(3000)]
    got = {r.row.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: rows[0][1]} | {i: f"own {i}\nend {i}" for i in range(1, 3000)}
