import hashlib
import random

import pytest

from linemill.llm import fingerprints as P


def test_spans_and_extensions():
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abé🙂") for _ in range(300)) for _ in range(2))
    x, y = P.PrefixHash(a), P.PrefixHash(a[40:] + b)
    assert x.span(40, 300) == y.span(0, 260) != y.span(1, 261)
    assert x.common(40, y, 0) == 260 and x.common(41, y, 0) == next(i for i in range(260) if a[41 + i] != a[40 + i])
    assert x.spans(7).tolist() == [x.span(i, i + 7) for i in range(294)]
    assert P.PrefixHash("").common(0, x, 0) == 0


def test_likeness():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefghij ") for _ in range(4000)) for _ in range(2))
    mark = lambda t: P.fingerprint(P.PrefixHash(t))
    assert P.likeness(mark(a), mark(a)) == 1 and P.likeness(mark(a), mark(b)) < 0.05
    assert 0.25 < P.likeness(mark(a), mark(a[:2000] + b[:2000])) < 0.75
    assert P.likeness(mark(""), mark("")) == 1 and P.likeness(mark(""), mark(a)) == 0
    assert P.likeness(mark("ab" * 5000), mark("ab" * 4000)) > 0.9 and mark("short") != mark("shorT")


def _share(a, b, width):
    """2 common / both of the distinct spans of two texts, by comparing texts."""
    x, y = ({t[i : i + width] for i in range(max(1, len(t) - width + 1))} for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y))


def test_likeness_is_near_the_true_share_of_spans():
    rng = random.Random(4)
    mark = lambda t: P.fingerprint(P.PrefixHash(t))
    wrong = []
    for _ in range(150):
        n = rng.choice([10, 30, 100, 300, 3000])
        a, b = ("".join(rng.choice("abcdefghij \u00e9") for _ in range(n)) for _ in range(2))
        cut = rng.randrange(n)
        c = a[:cut] + b[: n - cut]
        got, want = P.likeness(mark(a), mark(c)), _share(a, c, P.NARROW if n < P.SHORT else P.WIDTH)
        wrong.append(abs(got - want))
    assert max(wrong) < 0.3 and sum(wrong) / len(wrong) < 0.05
    assert P.likeness(mark("one short text here"), mark("one short text there")) > 0.7


def test_fingerprints_are_of_all_spans_and_nothing_else():
    text = "the quick brown fox jumps over the lazy dog " * 9 + "end"
    p = P.PrefixHash(text)
    code = [ord(c) + 1 for c in text]
    spans = {}
    for base in P._BASES:  # the polynomial by Horner's rule, from the last code point down
        for i in range(len(text) - P.WIDTH + 1):
            h = 0
            for c in reversed(code[i : i + P.WIDTH]):
                h = (h * base + c) % (2**31 - 1)
            spans[i] = spans.get(i, 0) << 31 | h
    assert p.spans(P.WIDTH).tolist() == [spans[i] for i in range(len(spans))]
    assert P.fingerprint(p).split(".")[0] == f"{len(text):x}"


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_rows_match_brute_force(spark, partitions):
    rng = random.Random(partitions)
    texts = ["", None, "a", "é🙂x", "z" * 20_000] + ["".join(rng.choice("abc \n") for _ in range(rng.randrange(200))) for _ in range(30)]
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
    rows += [rows[3], (rows[7][0], "other"), (2**61, "far"), (2**61 + 1, "farther")]
    rows += [(None, "no id"), (None, None)] if partitions != 3 else []
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as ahead")
    got = P.fingerprints(frame.repartition(4), partitions=partitions).collect()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows))
    want = []
    for k, (i, t) in enumerate(order):
        n, nxt = len(t), order[(k + 1) % len(order)][1]
        want.append((None if i == -(2**63) else i, n, hashlib.sha256((t[: n - n // 2] + nxt[: n // 2]).encode()).hexdigest(), P.fingerprint(P.PrefixHash(t))))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.common_edited >= r.n_chars - r.n_chars // 2 for r in got)


def test_small_tables(spark):
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = P.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
