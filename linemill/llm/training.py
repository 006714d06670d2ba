"""Labelled rows to fit a classifier on, and what tells held-out rows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no model has seen: crc32 of the id's text is divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, y) of at most ``per_class`` labelled rows of each class that aren't held out, by the order of a hash of the id.

    Rows with null ids or labels are left out; of several labels for an id the
    largest counts, of several texts under one id that with the least digest, so
    that repeated ids add no rows. Repeated texts count once.
    """
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id", F.lit("train"))
    picked = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * per_class rows, so that broadcasting them is safe
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "text", "y")).alias("x")).select("x.*")
    return one.groupBy("h").agg(F.first("text").alias("text"), F.max("y").cast("int").alias("y")).select("text", "y")
