"""How many rows Python workers hold at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Long texts come in batches of this many rows, so that a worker's memory is bounded by few of them.
ROWS = 500


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))
