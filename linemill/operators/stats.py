"""Line counts by file and by language; ranking; totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.functions.lexer import with_lines
from linemill.operators.detect import detect
from linemill.sources.registry import Registry

METRICS = ("files", "lines", "code", "comments", "blanks", "bytes")
SORT_KEYS = {"files": "files", "file": "files", "lines": "lines", "total": "lines", "code": "code", "comments": "comments", "comment": "comments", "blanks": "blanks", "blank": "blanks"}


def file_stats(files: DataFrame, registry: Registry | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """files: path, content (null: a file that counts without lines). A row a file of known language. keep: other columns of files that stay."""
    registry = registry or Registry()
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    rows = with_lines(detect(files, registry).select(*keep, "path", "language", "content", size.alias("file_size")), registry.specs)
    return rows.select(*keep, "path", "language", "file_size", F.col("l.total").alias("total_lines"), F.col("l.code").alias("code_lines"), F.col("l.comments").alias("comment_lines"), F.col("l.blanks").alias("blank_lines"))


def per_file(files: DataFrame, function: Callable[[str, bytes | None], dict], schema: str) -> DataFrame:
    """A row a file of what ``function`` makes of its path and content, as a dict of ``schema``'s columns."""
    columns = [f.strip().split()[0].strip("`") for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [function(p.as_py(), c.as_py()) for p, c in zip(b.column(0), b.column(1), strict=True)]
            if made:
                yield pa.RecordBatch.from_pylist([{c: m.get(c) for c in columns} for m in made])

    return files.select("path", "content").mapInArrow(run, schema)


def language_stats(stats: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Sums by language, with its ordinal: one shuffle of a row a language and task."""
    registry = registry or Registry()
    sums = stats.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), *(F.sum(f"{c}").alias(m) for c, m in (("total_lines", "lines"), ("code_lines", "code"), ("comment_lines", "comments"), ("blank_lines", "blanks"), ("file_size", "bytes")))
    )
    return sums.join(F.broadcast(registry.ordinals(stats.sparkSession)), "language")


def ranked(languages: DataFrame, sort: str = "lines", top: int = 0) -> DataFrame:
    """By a metric, greatest first, ties by ordinal; the first ``top``, or all for 0."""
    if sort not in SORT_KEYS:
        raise ValueError(f"unknown sort key: {sort}")
    out = languages.orderBy(F.desc(SORT_KEYS[sort]), "ordinal")
    return out.limit(top) if top > 0 else out


def totals(languages: DataFrame) -> DataFrame:
    """One row of sums over the rows that are shown."""
    return languages.agg(*(F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in METRICS))
