"""Mixing sources to target weights.

Weights are the sources' token shares raised to a power and normalised. The
power is found by bisection: the largest in [0, 1] whose mixture has the entropy
asked for, or, if nearer to 1, the smallest that keeps every source's repetition
within its limit. The weights are realised by block permutations: a source's
documents fall into blocks of about ``block_tokens`` (and ``block_rows`` rows at
most, by plan) by a hash, the blocks of a
source are taken in the order of a hash, whole passes first, then blocks until
the source's budget is met, documents of the last block in the order of a hash.
Only built-in expressions run, and only the one block of a source that its
budget cuts is ordered by document, so a source that holds a third of all rows
is never one task's work.

Where a source's budget ends is one row (its last whole block, the block that is
cut, the last hash in it), so documents are placed where they are read and no
text moves; only rows of the rarest sources do, where there are more than
``BROADCAST`` sources.

Cases. Tokens are runs of characters other than white space (0x20, 0x09-0x0D);
very long texts are counted whole. A null source is a source of its own. Null
and empty texts have no tokens and cost nothing; they appear once a whole pass,
and in the last pass if their block is in it. Repeated rows (same id and text)
fall into the same place together, as do ties of the hash. An empty table gives
an empty table. Other columns of any name stay inside ``row``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linemill.llm.scratch import Scratch
from linemill.llm.skew import counted, frequent

#: Blocks of a source at most, so that ordering them is small work; the blocks of a source that would have more are larger.
MOST_BLOCKS = 1 << 16
#: Sources up to which one row each is broadcast.
BROADCAST = 10_000
_POINTS, _ROUNDS = 15, 7


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(totals: DataFrame, total: float, powers: list[float]) -> list[tuple[float, float]]:
    """For each power: the mixture's entropy, and its largest weight relative to the share. One small aggregation."""
    share = F.col("source_tokens") / F.lit(float(total))
    columns = []
    for i, t in enumerate(powers):
        p = F.pow(share, F.lit(t))
        columns += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"e{i}"), F.max(F.pow(share, F.lit(t - 1.0))).alias(f"m{i}")]
    row = totals.filter("source_tokens > 0").agg(*columns).first()
    return [(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i in range(len(powers))]


def find_power(totals: DataFrame, total: float, budget: float, entropy: float, repetition: float) -> float:
    """Bisection, with four halvings of the interval a round. entropy: as a share of the greatest possible."""
    sources = totals.filter("source_tokens > 0").count()
    if sources < 2 or not total:
        return 1.0
    goal = entropy * math.log(sources)
    low, high = 0.0, 1.0  # low: flat enough. The answer is the largest power with the entropy asked for ...
    ok_low, ok_high = 0.0, 1.0  # ... but the least that keeps to the limit, if that is larger.
    first = _measures(totals, total, [0.0, 1.0])
    if first[1][0] >= goal:
        low = 1.0
    if first[0][1] * budget / total <= repetition:
        ok_high = 0.0
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)] if low < high else []
        ok_grid = [ok_low + (ok_high - ok_low) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)] if ok_low < ok_high else []
        if not grid and not ok_grid:
            break
        found = _measures(totals, total, grid + ok_grid)
        flat = [t for t, (e, _) in zip(grid, found, strict=False) if e >= goal]
        steep = [t for t, (e, _) in zip(grid, found, strict=False) if e < goal]
        low, high = max([low, *flat]), min([high, *steep])
        fits = [t for t, (_, m) in zip(ok_grid, found[len(grid) :], strict=True) if m * budget / total <= repetition]
        over = [t for t, (_, m) in zip(ok_grid, found[len(grid) :], strict=True) if m * budget / total > repetition]
        ok_low, ok_high = max([ok_low, *over]), min([ok_high, *fits])
    return max(low, ok_high)


def mix(
    docs: DataFrame, *, entropy: float = 0.95, repetition: float = 4.0, budget: float = 1.0, whole: bool = False, block_tokens: int = 1 << 20, block_rows: int = 1 << 18, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row a row of ``docs``: row (the input as a struct), n_tokens, weight, block, copies.

    entropy: of the mixture, as a share of ln(number of sources). repetition: passes over a source at most.
    budget: tokens of the mixture, as a share of all tokens. whole: raise the budget
    until every source has one pass at least; the limit of passes then also bounds that.
    block_tokens, block_rows: tokens and rows a block by plan.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string")))
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    own = docs.select(F.struct("*").alias("row"), source.alias("s"), h.alias("h"), tokens(F.col(text_col)).alias("n"))
    sizes = scratch.keep(own.select("s", "h", "n"), "sizes")
    totals = scratch.keep(sizes.groupBy("s").agg(F.sum("n").alias("source_tokens"), F.count(F.lit(1)).alias("source_rows")), "totals")
    total = totals.agg(F.sum("source_tokens")).first()[0] or 0
    # With ``whole``, a source's passes are its weight over its share, relative to the least such: power 1 gives 1 to all.
    if whole:
        power = _whole_power(totals, total, entropy, repetition)
        relative = F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(power - 1.0))
        least = totals.filter("source_tokens > 0").agg(F.min(relative)).first()[0] or 1.0
        passes = relative / F.lit(least)
    else:
        power = find_power(totals, total, budget * total, entropy, repetition)
        z = totals.filter("source_tokens > 0").agg(F.sum(F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(power)))).first()[0] or 1.0
        passes = F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(power)) / F.lit(z) * F.lit(budget * total) / F.nullif("source_tokens", F.lit(0))
    passes = F.least(F.round(passes, 9), F.lit(float(repetition)))
    plan = totals.select(
        "s",
        F.when(F.col("source_tokens") > 0, F.floor(passes)).otherwise(1).cast("int").alias("full"),
        F.when(F.col("source_tokens") > 0, F.floor((passes - F.floor(passes)) * F.col("source_tokens"))).otherwise(0).cast("long").alias("rest"),
        F.least(F.ceil(F.greatest(F.col("source_tokens") / F.lit(block_tokens), F.col("source_rows") / F.lit(block_rows))), F.lit(MOST_BLOCKS)).cast("long").alias("blocks"),
        F.pow(F.col("source_tokens") / F.lit(float(max(total, 1))), F.lit(power)).alias("raw"),
    )
    mass = plan.agg(F.sum(F.when(F.col("raw") > 0, F.col("raw")))).first()[0] or 1.0
    plan = scratch.keep(plan.withColumn("weight", F.col("raw") / F.lit(mass)).drop("raw"), "plan")
    block = F.pmod(F.col("h"), F.col("blocks"))
    few = scratch.rows(plan) <= BROADCAST
    blocks = sizes.join(F.broadcast(plan) if few else plan, "s").groupBy("s", "rest", block.alias("block")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("s").orderBy(_turn("block", seed)).rowsBetween(Window.unboundedPreceding, 0)
    # The running sum is over a source's blocks, not its documents.
    blocks = blocks.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    blocks = scratch.keep(blocks.select("s", "block", _turn("block", seed).alias("turn"), (F.col("rest") - F.col("before")).alias("left"), (F.col("upto") <= F.col("rest")).alias("in_whole")), "blocks")
    last = blocks.filter("in_whole").groupBy("s").agg(F.max("turn").alias("last"))
    cut = blocks.filter("not in_whole and left > 0").select("s", F.col("block").alias("cut"), "left")
    inside = sizes.join(F.broadcast(plan.select("s", "blocks").join(cut, "s")), "s") if few else sizes.join(plan.select("s", "blocks"), "s").join(cut, "s")
    inside = inside.filter(block == F.col("cut"))
    inner = Window.partitionBy("s").orderBy(F.col("h")).rangeBetween(Window.unboundedPreceding, 0)
    # Of the one block that is cut: the last hash up to which documents fit.
    edge = inside.withColumn("upto", F.sum("n").over(inner)).filter("upto <= left").groupBy("s").agg(F.max("h").alias("edge"))
    # All that a document needs to know is in one row a source.
    marks = scratch.keep(plan.join(last, "s", "left").join(cut.drop("left"), "s", "left").join(edge, "s", "left"), "marks")
    placed = own.join(F.broadcast(marks), "s") if few else _beside(own, marks, scratch.rows(sizes))
    placed = placed.withColumn("block", block)
    in_part = F.coalesce(_turn("block", seed) <= F.col("last"), F.lit(False)) | F.coalesce((F.col("block") == F.col("cut")) & (F.col("h") <= F.col("edge")), F.lit(False))
    return placed.select("row", F.col("n").alias("n_tokens"), "weight", "block", (F.col("full") + F.when(in_part & (F.col("rest") > 0), 1).otherwise(0)).alias("copies"))


def _turn(block: str, seed: int) -> Column:
    """Blocks of a source are taken in this order."""
    return F.struct(F.xxhash64(block, F.lit(seed + 1)), F.col(block))


def _beside(rows: DataFrame, marks: DataFrame, total: int) -> DataFrame:
    """Rows of sources with a thousandth of all rows, a thousand sources at most, stay where they are; the others move to their source's mark."""
    often = F.broadcast(frequent(counted(rows, ["s"]), ["s"], total).select("s"))
    here = rows.join(F.broadcast(marks.join(often, "s", "left_semi")), "s")
    return here.unionByName(rows.join(often, "s", "left_anti").join(marks, "s"))


def _whole_power(totals: DataFrame, total: float, entropy: float, repetition: float) -> float:
    """As ``find_power``, where the most repeated source has (most share / least share) ** (1 - power) passes."""
    sized = totals.filter("source_tokens > 0")
    row = sized.agg(F.max("source_tokens").alias("most"), F.min("source_tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if row.n < 2 or row.most == row.least:
        return 1.0
    by_entropy = find_power(totals, total, 0.0, entropy, math.inf)
    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        if (row.most / row.least) ** (1 - mid) <= repetition:
            high = mid
        else:
            low = mid
    return max(by_entropy, high)


def rows_mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in its own columns, every row as often as the mixture has it."""
    out = mix(docs, **options)
    each = out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("c"))
    return each.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens", F.round("weight", 9).alias("weight"), "block", "copies")
