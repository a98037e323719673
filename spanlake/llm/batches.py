"""A corpus as rows of some megabytes of text each, written once: later steps read these in place of single documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean



BATCH_BYTES = 6 << 20


def pack(x: np.ndarray | bytes) -> bytes:
    """Zstandard; the first 8 bytes are the raw length."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b"", dtype)


def gather(docs: DataFrame, columns: list[str], make: Callable[[int, pa.Table], pa.RecordBatch], schema: str, size: int = BATCH_BYTES) -> DataFrame:
    """Rows of ``make(batch number, documents)``, each of documents with about ``size`` bytes of text.

    The numbers are unique within the table; they are fixed once it is written, so write it before use.
    """

    def scan(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, weight = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            at = 0
            sizes = np.cumsum(np.maximum(1, pa.compute.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            while at < b.num_rows:
                before = int(sizes[at - 1]) if at else 0
                take = int(np.searchsorted(sizes, before + size - weight, "left")) + 1 - at
                piece = b.slice(at, max(1, take))
                held.append(piece)
                at += piece.num_rows
                weight += int(sizes[at - 1]) - before
                if weight >= size:
                    yield make(number, pa.Table.from_batches(held))
                    number, held, weight = number + 1, [], 0
        if held:
            yield make(number, pa.Table.from_batches(held))

    import pyarrow.compute  # noqa: F401

    return docs.select(*columns).mapInArrow(lean(scan), schema)


def with_replies(batched: DataFrame, replies: DataFrame, name: str = "parts") -> DataFrame:
    """``batched`` with the replies to each batch, at most one from each shard, as a list."""
    own = replies.groupBy("batch").agg(F.collect_list(F.struct("shard", "vals")).alias(name))
    return batched.join(own, "batch", "left")



