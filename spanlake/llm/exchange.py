"""Sums by key, gathered over all batches and handed back to each batch.

A batch of documents holds hundreds of thousands of distinct 64-bit keys (words, n-grams, passages).  Sending each as
a row of its own costs more than the work on it, so a batch sends one row per shard (a range of the key space), with
the keys sorted and packed.  Each key comes once per batch, whatever its frequency: hot keys are aggregated before the
shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import pack, unpack

REQUEST = "shard int, batch long, keys binary, vals binary"
REPLY = "batch long, shard int, vals binary"


def split(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of the keys of each shard, by key; the same on the way out and back."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.searchsorted(keys[order] >> np.uint64(32), np.array([(s << 32) // shards for s in range(1, shards)], np.uint64)))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys share their high bytes: byte planes compress."""
    return pack(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def requests(batch: int, keys: np.ndarray, vals: np.ndarray, shards: int) -> pa.RecordBatch:
    parts = [(s, ix) for s, ix in enumerate(split(keys, shards)) if len(ix)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _ in parts], pa.int32()),
            pa.array([batch] * len(parts), pa.int64()),
            pa.array([pack_keys(keys[ix]) for _, ix in parts], pa.binary()),
            pa.array([pack(vals[ix]) for _, ix in parts], pa.binary()),
        ],
        ["shard", "batch", "keys", "vals"],
    )


def answers(parts: list[dict] | None, keys: np.ndarray, shards: int, dtype) -> np.ndarray:
    """The replies to a batch, in the order of its keys."""
    out = np.zeros(len(keys), dtype)
    places = split(keys, shards)
    for p in parts or []:
        out[places[p["shard"]]] = unpack(p["vals"], dtype)
    return out


def sum_by_key(asked: DataFrame, fields: list[tuple[str, str]], reply: list[tuple[str, str]]) -> DataFrame:
    """Reply with the sums of the ``fields`` of ``vals`` (records) for each key, in the types of ``reply``.

    ``reply`` may add ``owner``, which is true for one batch of those that sent the key: there, each key can be
    counted exactly once.
    """
    into, back = np.dtype(fields), np.dtype(reply)

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        parts = [unpack_keys(b) for b in group.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        vals = np.concatenate([unpack(b, into) for b in group.column("vals").to_pylist()])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        starts = np.flatnonzero(new)
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(new) - 1
        out = np.zeros(len(keys), back)
        for f in into.names:
            out[f] = np.add.reduceat(vals[f][order].astype(np.float64 if into[f].kind == "f" else np.int64), starts)[which]
        if "owner" in back.names:
            out["owner"][order[starts]] = True  # a stable order: the first batch
        cut = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table(
            {
                "batch": group.column("batch").cast(pa.int64()),
                "shard": group.column("shard").cast(pa.int32()),
                "vals": pa.array([pack(x) for x in np.split(out, cut)], pa.binary()),
            }
        )

    return asked.groupBy("shard").applyInArrow(merge, REPLY)


def shard_count(total_bytes: int, per_shard: int = 8 << 20) -> int:
    """So many shards that each holds about ``per_shard`` bytes of requests."""
    return max(8, -(-int(total_bytes) // per_shard))
