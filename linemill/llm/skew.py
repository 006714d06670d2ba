"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one frequent key are dealt to.
PARTS = 64
#: Rows that make a key frequent in a small table; in a large one it is a thousandth of them.
LEAST = 64


def frequent(counts: DataFrame, keys: list[str], total: int, count: str = "m") -> DataFrame:
    """The keys that hold a thousandth of all rows and ``LEAST`` or more: a thousand keys at most, so that broadcasting them is safe. counts: one row a key."""
    return counts.filter(F.col(count) >= max(LEAST, -(-total // 1000))).select(*keys, F.lit(True).alias("_often"))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, often: DataFrame) -> DataFrame:
    """Inner join of ``left``, where a key may hold very many rows, with ``right``, which has one row a key.

    Rows of the frequent keys (``often``) are dealt by a hash of column ``by`` as
    well, and meet a copy of the right row in each of ``PARTS`` places.
    """
    often = F.broadcast(often)
    dealt = left.join(often, keys, "left").withColumn("_salt", F.when(F.col("_often"), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(F.lit(0)).cast("int")).drop("_often")
    places = F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(often, keys, "left").withColumn("_salt", F.explode(places)).drop("_often")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """As ``spread_join``, where each row of both sides knows in ``m`` how many rows its key has."""
    parts = F.floor(F.col("m") / F.lit(4 * LEAST)).cast("int")
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), parts + 1).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts))).drop("m")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")
