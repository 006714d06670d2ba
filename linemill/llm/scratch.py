"""Intermediate tables in the folder that the cluster shares.

A table kept here cuts lineage: executors that are lost later do not force the
work before it to be done again. The folder is the session's
``spark.checkpoint.dir``, or else its checkpoint folder. Only where neither is
set and the master is local (one machine, as in tests) a temporary folder is
made; on a cluster each executor would write to its own disk, so that is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="linemill-")
    return _OWN[app]


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    path, fs = _path(spark, where)
    return bool(fs.exists(path))


class Scratch:
    """Tables of one run of an operator. They go when the session ends, or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = _path(spark, self.root)
        fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it as read from the shared folder."""
        self.n += 1
        where = f"{self.root}/{name}-{self.n}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(where)
        kept = self.spark.read.schema(df.schema).parquet(where)
        kept._linemill_path, kept._linemill_rows = where, seen.get.get("n", 0)
        return kept

    @staticmethod
    def rows(kept: DataFrame) -> int:
        """Rows of a table that was kept, counted as it was written."""
        return kept._linemill_rows

    def drop(self, *kept: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in kept:
            path, fs = _path(self.spark, df._linemill_path)
            fs.delete(path, True)
