"""A training-data pipeline over ``documents``: toxic texts go, repeated lines go,
of near copies one stays, sources are mixed, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of their docs, whatever further ones there are.

Cases. Null ids are least and never a reason to drop a row; null and empty texts
stay through all stages (they are not toxic, have no lines to lose and no near
copies) and encode to no ids. Very long texts are handled whole. Rows that repeat
an id and a text are one document: they pass toxicity and line dedup alike, and
near-copy removal leaves one of them, that with the least hash of all columns
where other columns differ. Ties (equal texts under different ids) go to the
smallest id. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from linemill.llm.bloom import BloomFilter
from linemill.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts stay."""
    return toxicity.rows_left(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; one that loses every line goes."""
    return line_dedup.rows_left(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays (five words, 0.8).

    Rows with the same id and text are one document. Null ids stay; different
    texts under one id stay or go together. Only keys move, and the rows that a
    filter of bounded size takes for one that leaves or is repeated.
    """
    scratch = Scratch(spark, "near_copies")
    k, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64("text").alias("th")
    stays = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    found = ngram_join.ngram_components(docs).groupBy(k).agg(F.max(stays).alias("stays"))
    gone = scratch.keep(found.filter("not stays").select("k"), "gone")
    again = scratch.keep(docs.select(k, th).groupBy("k", "th").count().filter("count > 1").select("k", "th"), "again")
    leaves, repeats = BloomFilter(gone, "k"), BloomFilter(again.select(F.xxhash64("k", "th").alias("key")), "key")
    rows = docs.select(F.struct("*").alias("row"), k, th)
    may = leaves.may_contain(F.col("k"), leaves.bits()) | repeats.may_contain(F.xxhash64("k", "th"), repeats.bits())
    one = rows.filter(may).join(gone, "k", "left_anti").groupBy("k", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.filter(~may).select("row").unionByName(one.select("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources up to 4 passes, as in op 6."""
    return mixing.rows_mixed(docs, entropy=0.95, repetition=4.0, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each row, how many they are, and whether they decode to its text."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("c", bpe.codec(spark)("text"))
    return rows.select("doc_id", "source", "c.ids", F.size("c.ids").cast("long").alias("n_tokens"), "c.exact")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned lexicons, alignment and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), "stage")
    return docs
