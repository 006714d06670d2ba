import math
import random
from collections import Counter
from itertools import combinations

import corpus_pipeline as C
from linemill.llm import bpe


def lines_left(rows):
    """Texts by id without the stretches of 20 words or more that an earlier document has; emptied ones go."""
    held, out = set(), {}
    for i, text, _ in sorted(rows):
        x = text.split("\n")
        cuts = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if len(" ".join(x[a:b]).split()) >= 20]
        gone = {k for a, b in cuts if tuple(x[a:b]) in held for k in range(a, b)}
        held |= {tuple(x[a:b]) for a, b in cuts}
        if len(gone) < len(x):
            out[i] = "\n".join(v for k, v in enumerate(x) if k not in gone)
    return out


def least_of_near_copies(texts):
    """Ids that are the least of their component, over all pairs."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    root = {i: i for i in texts}
    for _ in texts:
        for a, b in combinations(texts, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i for i in texts if root[i] == i}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    line = lambda n: " ".join(word() for _ in range(n))
    p, q = line(22), f"{line(12)}\n{line(11)}"
    texts = [f"{line(30)}\n{line(30)}" for _ in range(12)]
    texts += [f"{line(9)}\n{p}\n{line(9)}\n{q}\n{line(9)}", *(f"{line(9)}\n{q}\n{line(9)}\n{p}\n{line(9)}" for _ in range(3))]
    for near in range(4):  # by changed words, so that no line is shared
        w = [x.split() for x in texts[near].split("\n")]
        w[0][0], w[1][-1] = word(), word()
        texts.append("\n".join(map(" ".join, w)))
    texts += [texts[5], texts[6]]  # exact copies
    return [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]


def test_stages_and_run_match_brute_force(spark, tmp_path):
    rows = corpus()
    toxic = [(100, "you stupid pathetic moron", "s0"), (101, "what a worthless idiot, you stupid clown", "s1")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, _, _ in rows + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}
    clean = C.drop_toxic(spark, frame, str(tmp_path))
    assert texts(clean) == {i: t for i, t, _ in rows}
    left = lines_left(rows)
    assert texts(C.drop_repeated_lines(spark, clean, "")) == left and len(left) == len(rows) - 2
    shortened = spark.createDataFrame([(i, t, rows[i][2]) for i, t in left.items()], "doc_id long, text string, source string")
    stay = least_of_near_copies(left)
    assert {r.doc_id for r in C.drop_near_copies(spark, shortened, "").collect()} == stay and len(stay) == len(left) - 4
    got = C.run(spark, str(tmp_path))
    back = got.select("doc_id", "source", bpe.decoder(spark)("ids").alias("text"), "n_tokens", "ids").collect()
    assert {(r.doc_id, r.source, r.text) for r in back} == {(i, rows[i][2], left[i]) for i in stay}
    assert all(r.n_tokens == len(r.ids) for r in back)
    assert Counter(r.doc_id for r in back) == Counter(stay)  # near equal sources: nothing is repeated


def test_mixing_meets_its_entropy_beside_a_hot_source(spark):
    rows = [(i, f"word {i} of many", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(6000)]
    n = Counter(r.source for r in C.mix_sources(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect())
    assert set(n) == {r[2] for r in rows} and all(n[s] >= k for s, k in Counter(r[2] for r in rows).items())
    total = sum(n.values())
    assert -sum(k / total * math.log(k / total) for k in n.values()) / math.log(len(n)) >= 0.949


def test_stages_with_nulls_repeats_and_other_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, k int, th int, kept int, ids string, n int, s string, h int, block int, copies int, c int"
    extra = ("r", 1, 2, 3, "i", 4, "s", 5, 6, 7, 8)
    long = " ".join(f"w{i}" for i in range(60_000))
    given = [(None, "no id here", "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, long, "en", "b"), (5, long, "en", "b"), (3, "other text", "en", "a")]
    rows = [(*r, None if r[1] is None else len(r[1]), *extra) for r in given]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shown = lambda d: sorted(((r.doc_id, (r.text or "")[:20], r.source) for r in d.collect()), key=str)
    every = sorted(((i, (t or "")[:20], s) for i, t, _, s in given), key=str)
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name.startswith("BPE"):
            assert out.count() == len(given) and out.filter("exact").count() == len(given) and out.filter("n_tokens = 0").count() == 3
            continue
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {extra}
        if name == "toxicity":
            assert shown(out) == every
        elif name == "line dedup":
            assert shown(out) == [x for x in every if x[0] != 5]  # all of it is in document 4
        elif name.startswith("n-gram"):
            assert shown(out) == sorted({x for x in every if x[0] != 5}, key=str)
        else:
            assert set(shown(out)) == set(every)
