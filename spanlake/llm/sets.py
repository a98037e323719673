"""Sets of word n-grams of documents, and how the full sets of some of them are fetched."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .decontaminate import _bits, _passes
from .tables import lean

#: Bits of the filter of wanted ids, at most; it lets too many pass, never too few.
FILTER_BITS = 1 << 26


def set_digest(grams: np.ndarray) -> bytes:
    """What stands for a whole sorted set: the SHA-256 of its hashes."""
    return hashlib.sha256(grams.tobytes()).digest()


def shingle_rows(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for c in T.chunks(texts):
        w = T.words(c, "spaced")
        g = T.grams(w.hash, size)
        for r in range(c.rows):
            lo, hi = w.bounds[r], w.bounds[r + 1]
            if hi - lo >= size:
                yield np.unique(g[lo : hi - size + 1])
            else:
                yield T.grams(w.hash[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64)


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter (of bounded size) of the column ``low``, built where the ids are."""
    def fill(batches):
        for b in batches:
            h = T.mix(b.column("low").to_numpy().view(np.uint64))
            at = np.unique(np.concatenate(_bits(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    words = ids.select("low").mapInArrow(lean(fill), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, grams): the full sets of ``wanted(rep, low, digest)``; texts are read again, only sets that may be wanted are moved."""
    count = wanted.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * count).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, bits))

    def scan(batches):
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(known & _passes(shared.value, bits, T.mix(ids.fill_null(0).to_numpy().view(np.uint64))))))
            sets = list(shingle_rows(b.column("text"), size))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([set_digest(g) for g in sets], pa.binary()), pa.array([g.tobytes() for g in sets], pa.binary())], ["low", "digest", "grams"])

    found = docs.select("doc_id", "text").mapInArrow(lean(scan), "low long, digest binary, grams binary")
    return found.join(wanted, ["low", "digest"]).select("rep", "grams").dropDuplicates(["rep"])
