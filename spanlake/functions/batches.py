"""Bounds of the Arrow batches between Spark and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of one batch: what a worker holds doesn't grow with the texts' lengths or the partition.
ROWS, BYTES = 1024, 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Bounds the batches of Python functions on columns, for what the session plans from here on."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
