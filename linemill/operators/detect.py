"""Language detection as two broadcast joins on the registry, whose size is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linemill.functions.names import ascii_lower, basename, extension
from linemill.sources.registry import Registry


def detect(files: DataFrame, registry: Registry | None = None, *, keep_unknown: bool = False) -> DataFrame:
    """``files`` (with path) and its language; rows of unknown language go, or keep a null."""
    registry = registry or Registry()
    spark = files.sparkSession
    name = basename(F.col("path"))
    by_name = registry.filenames(spark).withColumnRenamed("key", "_by_name")
    by_ext = registry.extensions(spark).withColumnRenamed("key", "_by_ext")
    out = (
        files.withColumns({"_name": ascii_lower(name), "_ext": ascii_lower(extension(name))})
        .join(F.broadcast(by_name), F.col("_name") == F.col("name_lower"), "left")
        .join(F.broadcast(by_ext), F.col("_ext") == F.col("ext_lower"), "left")
        .withColumn("language", F.coalesce("_by_name", "_by_ext"))
        .drop("_name", "_ext", "_by_name", "_by_ext", "name_lower", "ext_lower")
    )
    return out if keep_unknown else out.filter("language is not null")
