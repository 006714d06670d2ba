"""Candidate pairs inside large groups of alike sets, by how the sets deviate from a centre.

Sets that share most of what they have can't be told apart by what they share;
they differ in where they deviate from the others. Let C be any set, D the
symmetric difference of A and C, n the size of A, and r = |D| - c n with
c = (1 - t) / (1 + t). Two sets have a Jaccard of t if and only if their
deviations share (r + r') / 2 elements or more. So:

- where r + r' <= 0 the two are linked: the least r of a group is linked with
  everything that is linked with anything in this way;
- every other pair shares an element of its deviations, and by the prefix
  principle a rare one: the set with the lesser r needs only its first
  |D| - r + 1 elements for that, the other its first ones down to the least r
  that a partner of it can have (by the triangle inequality).

No pair is lost, whatever the centre is. It is taken to be what most of a few
members hold, so that deviations are small and rare, and groups that share one
are far smaller than the group itself. Those that still are large are groups of
their own, around centres of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm.skew import frequent, sized_join, spread_join

#: Members whose majority is a group's centre, at most; any centre gives the same links.
SAMPLE = 9


def _majority():
    @F.arrow_udf("binary")
    def centre(few: pa.Array) -> pa.Array:
        out = []
        for sets in few:
            values, count = np.unique(np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in sets.values]), return_counts=True)
            out.append(values[2 * count > len(sets.values)].tobytes())
        return pa.array(out, pa.binary())

    return centre


def centres(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, m, centre) of each group. rows: (g, node, n, m); sets: (node, n, members)."""
    slot = F.pmod(F.xxhash64("node", "g"), F.lit(SAMPLE))
    some = rows.groupBy("g", slot.alias("slot")).agg(F.min(F.struct("node", "n")).alias("x"), F.first("m").alias("m")).select("g", "m", "x.node", "x.n")
    few = some.join(sets, ["node", "n"]).groupBy("g").agg(F.first("m").alias("m"), F.collect_list("members").alias("few"))  # SAMPLE sets at most
    return few.select("g", "m", _majority()("few").alias("centre"))


_SIGNS = ("s0", "s1", "s2", "s3")
_DEVIATION = "r long, d int, first int, es array<long>, at array<int>, " + ", ".join(f"{x} long" for x in _SIGNS)
_KIND = pa.struct([("r", pa.int64()), ("d", pa.int32()), ("first", pa.int32()), ("es", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), *((x, pa.int64()) for x in _SIGNS)])


def deviation(members: np.ndarray, centre: np.ndarray, percent: int, often) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """r times 100 + percent; |D|; how many elements come first for partners of the same r or more; elements for any partner, with their places.

    often: a function that gives the counts which order the elements. Elements
    that no other set holds keep their places but aren't listed.
    """
    q, n = 100 + percent, len(members)
    both = np.setxor1d(members, centre, assume_unique=True)
    d = len(both)
    r = q * d - (100 - percent) * n
    if not d:
        return r, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    count = often(both)
    order = np.lexsort((both, count))
    first = d - max(1, -(-r // q)) + 1
    longest = 100 * n // percent
    probe = min(d, d - max(1, -(-(r - (100 - percent) * longest) // q)) + 1)
    order = order[: max(probe, 0)]
    alone = np.isin(both[order], members, assume_unique=True) & (count[order] <= 1)
    at = np.flatnonzero(~alone)
    return r, d, first, both[order][at], at.astype(np.int32)


def parities(members: np.ndarray, centre: np.ndarray) -> list[int]:
    """256 bits: whether an odd number of elements of the deviation fall into each slot of the hash range.

    Where the bits of two sets differ, the sets do: they differ in that many elements at least.
    """
    slots = np.concatenate((members, centre)) >> np.uint64(56)  # what both have is counted twice
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=256) & 1).view(np.int64).tolist()


def _deviations(percent: int, bits: int, sketch):
    @F.arrow_udf(_DEVIATION)
    def found(members: pa.Array, centre: pa.Array) -> pa.Array:
        counts = sketch.value

        def often(x: np.ndarray) -> np.ndarray:
            return counts[(x >> np.uint64(64 - bits)).astype(np.int64)]

        out = []
        for m, c in zip(members, centre, strict=True):
            m, c = (np.frombuffer(v.as_buffer(), np.uint64) for v in (m, c))
            r, d, first, es, at = deviation(m, c, percent, often)
            out.append({"r": r, "d": d, "first": first, "es": es.view(np.int64), "at": at} | dict(zip(_SIGNS, parities(m, c), strict=True)))
        return pa.array(out, _KIND)

    return found


def deviations(rows: DataFrame, sets: DataFrame, percent: int, bits: int, sketch) -> DataFrame:
    """``rows`` (g, node, n, m, ...; m: the rows of the group) with r, d, first, es, at of each."""
    placed = sized_join(rows, centres(rows, sets), ["g"], "node").join(sets, ["node", "n"])
    return placed.select(*rows.columns, _deviations(percent, bits, sketch)("members", "centre").alias("x")).select(*rows.columns, "x.*")


def linked_by_centre(rows: DataFrame) -> DataFrame:
    """(a, b): links that follow from r alone, all with the least r of the group."""
    least = rows.groupBy("g").agg(F.min(F.struct("r", "node")).alias("x"), F.first("m").alias("m")).select("g", "m", F.col("x.r").alias("lr"), F.col("x.node").alias("b"))
    return sized_join(rows.select("g", "node", "r", "m"), least, ["g"], "node").filter("node != b and r + lr <= 0").select(F.col("node").alias("a"), "b").distinct()


def keys(rows: DataFrame) -> DataFrame:
    """A row for each element that a partner may share: key (of group and element), node, n, comp, r, d, pos, lead (enough for partners of the same r or more)."""
    each = rows.select("g", "node", "n", "comp", "r", "d", "first", *_SIGNS, F.explode(F.arrays_zip("es", "at")).alias("x"))
    return each.select(F.xxhash64("g", "x.es").alias("key"), "node", "n", "comp", "r", "d", *_SIGNS, F.col("x.at").alias("pos"), (F.col("x.at") < F.col("first")).alias("lead"))


def pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(node, n, pnode, pn) that share a key and whose places in both allow a link. rows: of ``keys``."""
    other = rows.select("key", *(F.col(x).alias(f"p{x}") for x in ("node", "n", "comp", "r", "d", "pos", *_SIGNS)))
    order = "(r < pr or (r = pr and (node < pnode or (node = pnode and n < pn))))"
    length = f"100L * least(n, pn) >= {percent}L * greatest(n, pn)"
    place = f"{2 * (100 + percent)}L * (least(pos, ppos) + 1 + least(d - 1 - pos, pd - 1 - ppos)) >= r + pr"
    apart = f"{100 + percent}L * ({' + '.join(f'bit_count({x} ^ p{x})' for x in _SIGNS)}) <= {100 - percent}L * (n + pn)"
    return rows.filter("lead").join(other, "key").filter(f"comp != pcomp and r + pr > 0 and {order} and {length} and {place} and {apart}").select("node", "n", "pnode", "pn")


def open_keys(rows: DataFrame, total: int) -> DataFrame:
    """Rows whose key lies in two components, with m: the rows of the key. total: of rows."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("lead").alias("any"))
    stats = stats.filter("lo != hi and any").select("key", "m")
    return spread_join(rows, stats, ["key"], "node", frequent(stats, ["key"], total))
