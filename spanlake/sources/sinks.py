"""Versioned outputs: a write becomes visible at once or not at all."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset, in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spanlake-")
    return found.rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: what is decided by their places there is the same at each reading."""
    path = f"{shared_folder(rows.sparkSession)}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class _Files:
    """The file system that holds ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_classes = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        at = self.path(path)
        self.fs = at.getFileSystem(conf)
        self.context = self.fs_classes.FileContext.getFileContext(self.fs.makeQualified(at).toUri(), conf)
        self.replace = spark.sparkContext._gateway.new_array(self.fs_classes.Options.Rename, 1)
        self.replace[0] = self.fs_classes.Options.Rename.OVERWRITE

    def path(self, path: str):
        return self.fs_classes.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(path))] if self.exists(path) else []

    def move(self, source: str, target: str) -> None:
        """In one step; a file at ``target`` is replaced."""
        self.context.rename(self.fs.makeQualified(self.path(source)), self.fs.makeQualified(self.path(target)), self.replace)

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        source = self.fs.open(self.path(path))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


def write_version(rows: DataFrame, path: str, outputs: Sequence[str] | None = None, by: str = "split", format: str = "json", keep: int = 2) -> dict:
    """Write ``rows`` as a new version of ``path``; returns its manifest.

    With ``outputs``, only rows whose ``by`` is one of these are written, a folder each, and counted in the same pass.
    Tasks write to a staging folder; once all have, it is moved to its own place and the manifest, which names the version
    that readers take, is replaced in one step.  A write that fails on its way leaves the version before as it was.  The
    last ``keep`` versions stay, for those who still read them; leftovers of failed writes go with the next success.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    path = path.rstrip("/")
    files = _Files(spark, path)
    staging = f"{path}/_staging/{version}"
    kept = rows if outputs is None else rows.filter(F.col(by).isin(*outputs))
    names = list(outputs or ())
    seen = Observation(f"write-{version}")
    counted = kept.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(by) == name, 1)).alias(f"n{i}") for i, name in enumerate(names)])
    writer = counted.write.format(format)
    (writer.partitionBy(by) if names else writer).save(staging)
    counts = seen.get
    before = current(spark, path)
    manifest = {
        "version": version, "format": format, "by": by if names else None, "rows": counts["rows"], "outputs": {name: counts[f"n{i}"] for i, name in enumerate(names)},
        "schema": rows.schema.json(), "versions": [version, *(before or {"versions": []})["versions"]][:keep],
    }
    files.move(staging, f"{path}/{version}")
    files.write(f"{path}/_staging/{version}.json", json.dumps(manifest, ensure_ascii=False))
    files.move(f"{path}/_staging/{version}.json", f"{path}/{MANIFEST}")
    for name in files.children(path):
        if name not in (MANIFEST, f".{MANIFEST}.crc", *manifest["versions"]):
            files.delete(f"{path}/{name}")
    return manifest


def current(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the version that readers take, None if there is none yet."""
    files = _Files(spark, path)
    at = f"{path.rstrip('/')}/{MANIFEST}"
    return json.loads(files.read(at)) if files.exists(at) else None


def read_version(spark: SparkSession, path: str, output: str | None = None) -> DataFrame:
    """The rows of the current version, of one ``output`` if it is named; an output without rows gives an empty frame."""
    from pyspark.sql.types import StructType

    manifest = current(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"{path} has no version")
    rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).format(manifest["format"]).load(f"{path.rstrip('/')}/{manifest['version']}")
    if output is None:
        return rows
    if output not in manifest["outputs"]:
        raise ValueError(f"{output} is none of the outputs {sorted(manifest['outputs'])}")
    return rows.filter(F.col(manifest["by"]) == output)
