"""Hidden names and ignore rules as joins, for trees that are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.functions import names
from linemill.functions.glob import as_bytes
from linemill.sources import ignore

#: Rules up to which they are one expression, and up to which they are broadcast.
LITERAL, BROADCAST = 200, 20_000
RULES = "dir string, depth int, line_no int, regex string, negated boolean, dir_only boolean, anchored boolean"


def hidden(rel: Column) -> Column:
    """Whether a component of the path starts with a dot."""
    return F.exists(F.split(rel, "/"), lambda c: c.startswith("."))


def rule_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rules of ignore files, given as {directory: text}; "" is the root."""
    rows = [
        (d, d.count("/") + 1 if d else 0, i, r.regex, r.negated, r.dir_only, r.anchored) for d, text in files.items() for i, r in enumerate(ignore.parse(text))
    ]
    return spark.createDataFrame(rows, RULES)


def _ancestors(rel: Column) -> Column:
    """Directories above a path, the root ("") first."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _matches(rel: Column, directory: str | Column, regex: str | Column, anchored: bool | Column) -> Column:
    """Whether a rule's expression matches: the path below its directory if it is anchored, else the last component."""
    inside = names.relative_path(rel, directory)
    if isinstance(anchored, bool):
        return F.rlike(as_bytes(inside if anchored else names.basename(rel)), F.lit(regex))
    return F.rlike(as_bytes(F.when(anchored, inside).otherwise(names.basename(rel))), regex)


def ignored_by(rel: Column, is_dir: bool, rules: list) -> Column:
    """Whether a path's last matching rule ignores it, as one expression of literal patterns. rules: rows of ``RULES``."""
    out = None
    for r in sorted(rules, key=lambda r: (r.depth, r.line_no), reverse=True):  # directories of one depth have no path in common
        if r.dir_only and not is_dir:
            continue
        met = _matches(rel, r.dir, r.regex, r.anchored)
        met = met if r.dir == "" else rel.startswith(r.dir + "/") & met
        out = F.when(met, not r.negated) if out is None else out.when(met, not r.negated)
    return F.lit(False) if out is None else F.coalesce(out, F.lit(False))


def ignored_paths(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(entry, is_dir) of those among ``entries`` that their last matching rule ignores.

    Every path meets the rules of the directories above it by an equi-join on the
    directory; which rule is last is an aggregate that combines before the shuffle.
    """
    met = entries.select("entry", "is_dir").distinct().withColumn("dir", F.explode(_ancestors(F.col("entry")))).join(rules, "dir")
    hits = met.filter((~F.col("dir_only") | F.col("is_dir")) & _matches(F.col("entry"), F.col("dir"), F.col("regex"), F.col("anchored")))
    last = hits.groupBy("entry", "is_dir").agg(F.max_by("negated", F.struct("depth", "line_no")).alias("negated"))
    return last.filter("not negated").select("entry", "is_dir")


def prune(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (with rel) that neither are ignored nor lie in an ignored directory.

    Up to ``LITERAL`` rules become one filter of literal patterns, and nothing
    moves. More are joined; up to ``BROADCAST`` of them are broadcast.
    """
    rel = F.col("rel")
    few = rules.limit(LITERAL + 1).collect()
    dirs = F.slice(_ancestors(rel), F.lit(2), F.size(F.split("rel", "/")))
    if len(few) <= LITERAL:
        return files.filter(~(ignored_by(rel, False, few) | F.exists(dirs, lambda d: ignored_by(d, True, few))))
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("regex") + F.length("dir")).alias("chars")).first()
    if size.n <= BROADCAST and size.chars <= 100 * BROADCAST:
        rules = F.broadcast(rules)
    own = F.struct(rel.alias("entry"), F.lit(False).alias("is_dir"))
    entries = files.select("rel", F.explode(F.concat(F.array(own), F.transform(dirs, lambda d: F.struct(d.alias("entry"), F.lit(True).alias("is_dir"))))).alias("x")).select("rel", "x.*")
    gone = entries.join(ignored_paths(entries, rules), ["entry", "is_dir"], "left_semi").select("rel").distinct()
    return files.join(gone, "rel", "left_anti")
