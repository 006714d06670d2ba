"""The quality classifier's statistics against plain Python, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from linemill.llm import quality as Q


def naive(text):
    """A row of STATS, from the text's bytes one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    n, m = max(len(data), 1), max(len(words), 1)
    signs = {c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|"}
    share = lambda keep: sum(map(keep, data)) / n
    lines = data.split(b"\n")
    counts = Counter(lower)
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / m, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in signs),
        share(lambda b: b in b".?,;:"), share(lambda b: b == 124), share(lambda b: b == 33), share(lambda b: b >= 128), len(words) / len(lines), len(counts) / m,
        max(counts.values(), default=0) / m, sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / m, sum(a == b for a, b in zip(lower, lower[2:], strict=False)) / m,
        sum(w[-1] in signs or w[-1] == 33 for w in words) / m, sum(len(w) == 1 for w in words) / m, max(map(len, words), default=0), 1 - len({bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in lines}) / len(lines),
    ]


def test_statistics_match_plain_python():
    rng = random.Random(12)
    parts = ["a", "The", "the", " ", " ", "\n", "\t", "!", "#", "1", "|", ".", "é", "漢", "x!", "\r\n", "ß "]
    texts = ["", None, "\n\n", "one"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = Q.statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, naive(t)), t


def test_empty_tables_repeated_rows_and_other_columns(spark):
    rng = random.Random(13)
    good = lambda: " ".join(rng.choice(["calm", "sea", "tree", "walk"]) + "," for _ in range(40))
    bad = lambda: " ".join(rng.choice(["#", "$$", "1|1"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0], (None, None)], "doc_id long, text string").selectExpr("*", "'x' as s", "1 as score", "2 as y", "3 as h")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = Q.score(docs, model).collect()
    assert len(got) == 303 and len({r.score for r in got if r.doc_id == 0}) == 1
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None)
    assert Q.score(docs.limit(0), model).collect() == []
    assert Q.fit(docs.limit(0), labels) == (30.0, []) == Q.fit(docs, labels.limit(0))
