"""Exact dedup through a persistent digest index.

The index is a Parquet table bucketed and sorted by digest in the shared folder.
New rows are digested, pre-aggregated to one row a digest, and meet the index in
a sort-merge anti-join, whose index side needs no exchange; digests that are new
are appended. So a group of copies, however large, is one row after the map-side
aggregation. Only built-in expressions run.

The number of buckets lies beside the table and is read back by whoever opens
the index later, in any session and under any settings; another number is
refused. The table's name in the catalog is a digest of its whole path and of
that number, so that two folders never share one.

Cases. Texts are equal when they are identical after lower-casing A-Z, whole and
however long. Of equal texts the row with the largest id stays (null ids are
least); null counts as empty, and empty texts equal each other. Rows with the
same id and text are one document that may appear repeatedly: each repetition is
listed and counted, and ties of the largest id all stay. An id that stayed from
an earlier ingest keeps its place. An empty table gives an empty table and adds
nothing. Other columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.scratch import Scratch, _path, exists, shared_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text with A-Z lower-cased."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size at first sight, ingest).

    path: a folder that all executors share. buckets: fixed when the index is
    made (64 if not given); of an index that is there, the number found.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.rows, shape = f"{self.path}/rows", f"{self.path}/shape"
        if not exists(spark, f"{shape}/_SUCCESS"):
            spark.range(1).select(F.lit(buckets or 64).alias("buckets")).write.mode("overwrite").parquet(shape)
        self.buckets = spark.read.schema("buckets int").parquet(shape).first().buckets
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index in {self.path} has {self.buckets} buckets, not {buckets}")
        self.table = "digest_index_" + hashlib.sha256(f"{self.buckets} {self.path}".encode()).hexdigest()[:40]
        where = self.rows.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT, ingest STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{where}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame, name: str) -> DataFrame:
        """digests: (digest, doc_id). Appends those that are new, under ``name``; returns all of that name.

        Rows that the index has, under whatever name, add nothing, so an ingest may be repeated after a failure.
        """
        new = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if exists(self.spark, f"{self.rows}/_SUCCESS"):
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        columns = new.select("digest", "keep_id", "group_size", F.lit(name).alias("ingest"))
        # One file a bucket: rows are dealt as the buckets deal them.
        columns.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return self.read().filter(F.col("ingest") == name)

    def drop_at_exit(self) -> None:
        """Remove the folder when the session ends."""
        path, fs = _path(self.spark, self.path)
        fs.deleteOnExit(path)


def exact_dedup(docs: DataFrame, index: DigestIndex, name: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the id that stays, of this ingest or of an earlier one; group_size
    counts the rows of the ingest that first brought the digest.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    scratch = Scratch(docs.sparkSession, "digests")
    own = scratch.keep(own)
    index.ingest(own, name)
    # A digest of a thousandth of all rows or more is one of a thousand at most: those are broadcast, and their rows stay where they are.
    least = max(1000, -(-scratch.rows(own) // 1000))
    hot = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("digest")
    hot = F.broadcast(index.read().join(hot, "digest", "left_semi"))
    rare = own.join(hot.select("digest"), "digest", "left_anti").join(index.read(), "digest")
    return own.join(hot, "digest").unionByName(rare).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index.drop_at_exit()
    return exact_dedup(docs.select("doc_id", "text"), index, "first")


OP10_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
