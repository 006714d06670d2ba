"""Quality, token counts, exact dedup, and the SQL and pipeline of the subpackage."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linemill.llm import exact_dedup as E
from linemill.llm import quality as Q
from linemill.llm import queries
from linemill.llm.scratch import shared_dir
from linemill.llm.token_counts import TokenRollup, deleted, inserted, revised

SF = "/root/testdata/sf0.001"


def test_statistics():
    texts = ["", None, "One two two.\nOne two two.", "A | B | C", "x" * 2_000_000, "é!!"]
    got = Q.statistics(pa.array(texts))
    at = Q.STATS.index
    assert got.shape == (6, len(Q.STATS)) and np.isfinite(got).all() and not got[0, :10].any() and (got[0] == got[1]).all()
    assert got[2, at("repeated_lines")] == 0.5 and got[2, at("distinct")] == 0.5 and got[2, at("line_words")] == 3
    assert got[3, at("bar")] == 2 / 9 and got[5, at("non_ascii")] == 0.5 and got[4, at("longest_word")] == 2_000_000
    for t, row in zip(texts, got, strict=True):  # alone or among others, a text has the same
        assert np.allclose(Q.statistics(pa.array([t], pa.string()))[0], row)


def test_rules_in_spark_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((800, len(Q.STATS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] < 0.5) | (x[:, 7] > 0.9)).astype(float)
    intercept, rules = Q.fit_rules(x, y)
    total = intercept + sum(w * np.all([(x[:, f] <= c) == b for f, c, b in r], axis=0) for w, r in rules)
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, s array<double>")
    got = [r.p for r in frame.select("i", Q.compile_rules(intercept, rules, F.col("s")).alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert (((np.array(got) >= 0.5) == y).mean()) > 0.97 and 0 < len(rules) < 300


def test_quality_holds_on_held_out_rows(spark):
    rows = Q.op7(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.95
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(Q.score(docs, Q.fit(docs, none)).collect()) == 2


def test_rollup(spark):
    one = F.lit(5).cast("long")
    docs = spark.createDataFrame([("a", "en"), ("a", "en"), (None, "en"), ("b", None)], "source string, lang string").selectExpr("*", "1 as n_docs")
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-test-{random.random()}")
    assert rollup.totals().collect() == []
    assert rollup.commit("x", inserted(docs, "v1", one)) and not rollup.commit("x", inserted(docs, "v1", one))
    rollup.commit("y", revised(docs.filter("source = 'a'"), "v1", one, one + 2))
    rollup.commit("z", deleted(docs.filter("source = 'b'"), "v1", one))
    rollup.commit("w", inserted(docs.limit(0), "v1", one))
    want = sorted([("a", "en", "v1", 2, 14), (None, "en", "v1", 1, 5)], key=str)
    shown = lambda: sorted(map(tuple, rollup.totals().collect()), key=str)
    assert shown() == want
    assert rollup.compact() == 4 and rollup.batches() == [] and shown() == want
    assert not rollup.commit("x", inserted(docs, "v1", one)) and rollup.compact() == 0 and shown() == want
    spark.createDataFrame([("u",)], "batch string").write.parquet(f"{rollup.root}/names=2")  # a fold that was cut off
    assert rollup.commit("u", deleted(docs.filter("source is null"), "v1", one)) and shown() == [("a", "en", "v1", 2, 14)]
    assert rollup.compact() == 1 and shown() == [("a", "en", "v1", 2, 14)] and not rollup.commit("u", inserted(docs, "v1", one))


def test_digest_index(spark):
    rows = [(1, "Ab"), (5, "aB"), (3, "É"), (4, "é"), (6, None), (7, ""), (None, "ab"), (5, "aB"), (8, "x" * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as digest", "1 as keep_id")
    index = E.DigestIndex(spark, f"{shared_dir(spark)}/digests-test-{random.random()}", 4)
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(frame, index, "one").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("ab")] == (5, 4, False) and got[5, sha("ab")] == (5, 4, True) and got[None, sha("ab")] == (5, 4, False)
    assert got[6, sha("")] == (7, 2, False) and got[3, sha("É")] == (3, 1, True) and got[4, sha("é")] == (4, 1, True)
    more = spark.createDataFrame([(90, "AB"), (91, "new")], "doc_id long, text string")
    again = E.DigestIndex(spark, index.path, 4)
    later = {r.doc_id: (r.keep_id, r.kept) for r in E.exact_dedup(more, again, "two").collect()}
    assert later == {90: (5, False), 91: (91, True)} and again.read().count() == 6
    E.exact_dedup(more, again, "two")
    assert again.read().count() == 6
    met = more.select(E.digest(F.col("text")).alias("digest")).repartition(4, "digest").join(again.read().select("digest").hint("merge"), "digest", "left_anti")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and plan.count("Exchange ") == 1
    hot = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('own ', id)) as text")
    found = E.exact_dedup(hot, again, "hot").groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, found)) == [(1, True, 4000), (2000, False, 1999), (2000, True, 1)]
    assert E.exact_dedup(frame.limit(0), again, "none").collect() == []


def test_index_opened_again_under_other_settings(spark):
    path = f"{shared_dir(spark)}/digests-again-{random.random()}"
    docs = spark.range(400).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert E.exact_dedup(docs, E.DigestIndex(spark, path, 16), "one").filter("kept").count() == 400
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        spark.sql(f"DROP TABLE {E.DigestIndex(spark, path).table}")  # as in a new session
        again = E.DigestIndex(spark, path)
        assert again.buckets == 16 and again.ingest(docs.select(E.digest(F.col("text")).alias("digest"), "doc_id"), "two").count() == 0
        assert again.read().count() == 400
        with pytest.raises(ValueError, match="16 buckets"):
            E.DigestIndex(spark, path, 8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    one, other = (E.DigestIndex(spark, f"{path}{x}") for x in ("-1", "_1"))
    one.ingest(docs.select(F.lit("d").alias("digest"), "doc_id"), "x")
    assert one.read().count() == 1 and other.read().count() == 0 and one.table != other.table


def test_scratch_is_refused_where_executors_do_not_share_it(monkeypatch):
    class Somewhere:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://head:7077", "app-other"
        getConf = staticmethod(Somewhere)

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    session = type("S", (), {"sparkContext": Context, "conf": Somewhere()})
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(session)
    Context.master = "local[2]"
    assert shared_dir(session).startswith("file:///")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), entry.queries()[name](spark, SF).toPandas()
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert sorted(want.columns) == sorted(got.columns) and rows(want) == rows(got)


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    kept = C.drop_toxic(spark, docs, SF)
    assert kept.columns == columns and sum(labels.get(i) == 0 for i in ids(kept)) >= 0.95 * sum(v == 0 for v in labels.values())
    cut = C.drop_repeated_lines(spark, docs, SF)
    assert cut.columns == columns and ids(cut) <= ids(docs)
    near = C.drop_near_copies(spark, docs, SF)
    assert near.columns == columns and near.count() == len(ids(near)) < docs.count()
    mixed = C.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and ids(mixed) == ids(docs)
    coded = C.encode(spark, docs, SF)
    assert coded.count() == docs.count() and coded.filter("n_tokens = 0").count() == docs.filter("text = ''").count()
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
