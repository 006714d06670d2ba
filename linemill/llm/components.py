"""Connected components of an edge table, by alternating large and small stars.

Each step is two aggregations and a join whose rows number at most the edges;
a hub's rows are combined before the shuffle and its join side can be split.
Up to ``FEW`` edges, which are 2 MB, are united by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.llm.scratch import Scratch

#: Edges up to which one task unites them.
FEW = 1 << 17


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v, each once. Links the neighbours of each node to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u != v").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one link down or is a centre: then each centre is its component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of one partition, by union-find."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(top, nodes)), pa.int64())], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (a, b) in any order. Returns (node, root), root the least node; no row for nodes without edges."""
    now = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges"
    )
    if scratch.rows(now) <= FEW:
        return now.coalesce(1).mapInArrow(_united, "node long, root long")
    while not _stars_only(now):
        after = scratch.keep(_star(_star(now, True), False), "stars")
        scratch.drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
