"""Rare-first prefixes of sets of hashes, and the check of pairs on full sets, whose texts travel once to each group of their pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import staged

#: Counters of the frequency order, and the rows that a task sends them in.
BUCKETS, SLICES = 1 << 20, 64
#: Sets that are at home together, and hashes of these, about.
HOME_ROWS, HOME_HASHES = 512, 1 << 17
#: Bits of the filter of wanted ids, at most (8 MB), and those of one id.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, BUCKETS // SLICES * 8, codec="zstd", asbytes=True), np.int64)


def _places(hashes: np.ndarray) -> np.ndarray:
    return hashes & (BUCKETS - 1)


def frequency_order(sets: DataFrame) -> np.ndarray:
    """For each bucket of the hashes of ``sets(g)`` a 16-bit code that rises with their number; 8 MB at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_places(b.column("g").flatten().to_numpy()), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(map(_pack, np.split(total, SLICES)), pa.binary())], ["slice", "counts"])

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"slice": group.column("slice").slice(0, 1).cast(pa.int32()), "counts": pa.array([_pack(sum(map(_unpack, group.column("counts").to_pylist())))], pa.binary())})

    schema = "slice int, counts binary"
    found = sets.select("g").mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema).toArrow()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for s, b in zip(found.column("slice").to_pylist(), found.column("counts").to_pylist(), strict=True):
        out[s] = _unpack(b)
    return (np.log2(out.ravel() + 1.0) * 1024).astype(np.uint16)


def prefixes(sets: DataFrame, order: np.ndarray, threshold: float) -> DataFrame:
    """doc_id, block, n, digest and prefix of ``sets(doc_id, block, g)``: the n - ceil(threshold * n) + 1 rarest hashes, in order.

    All sets are in one order, so sets that alike share a hash of their prefixes.
    """
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for b in batches:
            n, digest, prefix = [], [], []
            for at in range(b.num_rows):
                g = b.column("g")[at].values.to_numpy()
                rare = (code[_places(g)].astype(np.uint64) << np.uint64(48)) | (g.view(np.uint64) >> np.uint64(16))
                n.append(len(g))
                digest.append(hashlib.sha256(g.tobytes()).digest())
                prefix.append(g[np.argsort(rare, kind="stable")][: len(g) - int(np.ceil(threshold * len(g))) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefix])].astype(np.int32)), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "block", "n", "digest", "prefix"])

    return sets.select("doc_id", "block", "g").mapInArrow(scan, f"doc_id {sets.schema['doc_id'].dataType.simpleString()}, block string, n long, digest binary, prefix array<long>")


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return common >= threshold * (len(x) + len(y) - common)


def passing(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` may be one of ``ids(doc_id)``, by a Bloom filter of bounded size: it lets too many pass, never too few."""
    bits = min(FILTER_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    places = lambda h: F.array(*(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)))
    at = ids.select(F.explode(places(F.col("doc_id"))).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    words = at.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toArrow()
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").flatten().to_numpy().reshape(b.num_rows, FILTER_HASHES)
            found = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield b.drop_columns(["at"]).filter(pa.array(found.all(axis=1)))

    return rows.withColumn("at", places(F.col("doc_id"))).mapInArrow(scan, rows.schema)


def confirmed(pairs: DataFrame, texts: DataFrame, hashes: Column, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b, na, nb)``, a < b, whose full sets, ``hashes`` of the row of ``texts(doc_id, text)``, are similar enough.

    A set is at home with the smallest one that it is paired with; large homes are dealt into blocks by the sizes na and nb.
    A text isn't sent with each of its pairs, but once to each two homes that these lie between, and becomes a set there.
    """
    kind = texts.schema["doc_id"].dataType
    sides = pairs.select(F.col("a").alias("doc_id"), F.col("a").alias("of"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("of"), F.col("nb").alias("n")))
    ids = staged(sides.groupBy("doc_id").agg(F.min("of").alias("of"), F.max("n").alias("n")))
    blocks = ids.groupBy("of").agg(F.ceil(F.greatest(F.count("*") / HOME_ROWS, F.sum("n") / HOME_HASHES)).alias("blocks"))
    homes = ids.join(blocks, "of").select("doc_id", F.xxhash64("of", F.pmod(F.xxhash64("doc_id"), "blocks")).alias("home"))
    at = pairs.select("a", "b").join(homes.toDF("a", "ha"), "a").join(homes.toDF("b", "hb"), "b")
    at = staged(at.select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("group")))
    needed = at.select("group", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(passing(texts.select("doc_id", "text"), ids.select("doc_id")), "doc_id")
    met = needed.select("group", "doc_id", F.lit(None).cast(kind).alias("other"), "text").unionByName(at.select("group", F.col("a").alias("doc_id"), F.col("b").alias("other"), F.lit(None).cast("string").alias("text")))
    met = met.repartition("group").sortWithinPartitions("group", F.col("other").asc_nulls_first()).select("group", "doc_id", "other", hashes.alias("g"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            a, b, g = [], [], batch.column("g")
            for at, (own, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "other")), strict=True)):
                if own != group:
                    group, held = own, {}
                if y is None:  # sets come before the pairs
                    if g[at].is_valid:
                        held.setdefault(x, []).append(g[at].values.to_numpy())
                elif any(_similar(s, t, threshold) for s in held[x] for t in held[y]):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("doc_id").type), pa.array(b, batch.column("doc_id").type)], ["a", "b"])

    return met.mapInArrow(check, f"a {kind.simpleString()}, b {kind.simpleString()}")
