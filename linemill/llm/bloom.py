"""A blocked Bloom filter of bounded size, built and asked by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _masks(key: Column) -> list[Column]:
    """Of a key's block of four words, the bits that it sets: two in each word."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    shift = lambda i: F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")
    left = lambda i: F.call_function("shiftleft", one, shift(i))
    return [left(2 * w).bitwiseOR(left(2 * w + 1)) for w in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long")).cast("int")


class BloomFilter:
    """Blocks of 256 bits; 16 keys a block by plan, so about one wrong pass in 300."""

    def __init__(self, keys: DataFrame, key: str, max_blocks: int = 1 << 16):
        n = keys.count()
        self.blocks = max(1, min(max_blocks, 1 << max(0, (max(1, n) // 16).bit_length())))
        spark = keys.sparkSession
        words = keys.select(_block(F.col(key), self.blocks).alias("b"), F.posexplode(F.array(*_masks(F.col(key)))).alias("w", "m"))
        words = words.groupBy((F.col("b") * 4 + F.col("w")).cast("long").alias("id")).agg(F.bit_or("m").alias("m"))
        every = spark.range(4 * self.blocks).join(words, "id", "left").select(F.struct("id", F.coalesce("m", F.lit(0)).alias("m")).alias("x"))
        # One row of 4 * blocks words: 2 MB at most.
        self._words = every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("bits"))

    def bits(self) -> Column:
        return self._words.scalar()

    def may_contain(self, key: Column, bits: Column) -> Column:
        at = _block(key, self.blocks) * 4
        ok = None
        for w, m in enumerate(_masks(key)):
            one = F.get(bits, at + w).bitwiseAND(m) == m
            ok = one if ok is None else ok & one
        return ok
