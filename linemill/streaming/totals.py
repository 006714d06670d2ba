"""Running totals by language over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.operators.stats import file_stats
from linemill.sources.registry import Registry


def running_totals(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """files: a stream of (path, content). Sums by language, for output modes complete and update."""
    stats = file_stats(files, registry)
    return stats.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("total_lines").alias("lines"), F.sum("code_lines").alias("code"), F.sum("comment_lines").alias("comments"), F.sum("blank_lines").alias("blanks"))
