"""Reading inputs and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between Spark and Python; long texts are bounded by the bytes.
ARROW_ROWS, ARROW_BYTES = 4096, 4 << 20
#: Bytes that a task holds of a table it writes.
ROW_GROUP = 16 << 20
#: Tasks, for each core of the session, that write a compacted table.
TASKS_A_CORE = 4


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for mapInArrow; a worker that is kept for further tasks gives its free memory back after each."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Free memory of a worker goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library: nothing to trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset, in a local session."""
    app = spark.sparkContext.applicationId
    try:
        found = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:
        found = None
    found = found or _own.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own[app] = "file://" + tempfile.mkdtemp(prefix="spanlake-")
    return found.rstrip("/")


#: Folders of local sessions without the setting, by application.
_own: dict[str, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def compacted(df: DataFrame) -> DataFrame:
    """Like ``materialize``, in fewer files: partitions share a task, one after the other.

    On a local store an executor starts a process for each file it creates, to set permissions; until that runs, it
    counts as a copy of the executor's memory, so thousands of small files may seem to take twice what is held.  Not for
    rows that are numbered by the task that they are made in, nor for large rows: their tasks would
    hold more.
    """
    return materialize(df.coalesce(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism))


#: Where ``materialize`` has written the tables that are still in use.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in tables:
        if path := _written.pop(df, None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` (all) with numbers of the rows in ``row``, the same at each reading.

    A row of Parquet files is its file's number and its place in the file, so nothing is written; the rows of other
    frames are numbered in a table.
    """
    columns = columns or tuple(docs.columns)
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return materialize(docs.select(*columns).withColumn("row", F.monotonically_increasing_id()))
    files = sorted(r.file for r in placed.select("file").distinct().collect())
    named = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "file string, base long")
    return placed.join(named, "file").select(*columns, (F.col("base") + F.col("place")).alias("row"))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``materialize``, dealt by ``key`` once: joins on it leave these rows where they are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"spanlake_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("path", path).bucketBy(n, key).format("parquet").saveAsTable(name)
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)
