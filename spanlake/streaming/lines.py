"""Line streams and continuous appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.curate import bucket


def read_lines(spark: SparkSession, folder: str, schema: str, keep: Column | None = None) -> DataFrame:
    """A stream of JSON lines; lines that don't parse are dropped, and those that ``keep`` denies."""
    rows = spark.readStream.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(folder).filter("_corrupt is null").drop("_corrupt")
    return rows if keep is None else rows.filter(keep)


def in_training(id_: Column, share: float) -> Column:
    """The stable split of a stream: the same rows as in a batch."""
    return bucket(F.lit("ridx:"), id_) < int(share * 10_000)


def append(rows: DataFrame, path: str, checkpoint: str, seconds: float = 0.5, once: bool = False) -> StreamingQuery:
    """Append finished rows to JSON files as they come; ``once`` ends when what is there is written."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def append_once(rows: DataFrame, path: str, checkpoint: str, format: str = "json", seconds: float = 0.5, once: bool = False) -> StreamingQuery:
    """Append finished rows as they come, each exactly once: a batch has a folder of its own number, and is written anew if it is retried.

    After a crash the stream goes on from ``checkpoint``: the batch that was under way comes again with its number, so what
    had been written of it is replaced.  ``read_appended`` reads the rows.
    """
    path = path.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(format).save(f"{path}/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_appended(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """The rows of ``append_once``, with the number of their ``batch``."""
    return spark.read.schema(f"{schema}, batch long").format(format).load(path)
