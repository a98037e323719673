"""Benchmark decontamination by winnowing.

Of each 10 consecutive words, winnowing keeps the smallest hash among the 6 runs of 5 words in them.  A window shared
by an item and a document therefore keeps the same run in both, so a join of the kept runs (the fingerprints) misses
no shared window.  Each joined fingerprint is then extended to the windows of 10 words that hold it, and these are
compared as texts.  Items of fewer words are fingerprinted whole, by their own number of words.

Null and empty texts have no words and are never hit.  Repeated document rows each give a row; rows of one id share
their hits.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .tables import lean, materialize, prepare

WINDOW, GRAM = 10, 5
#: Bits of the Bloom filter that spares the join most fingerprints, at most (8 MB); it only ever lets too many pass.
FILTER_BITS = 1 << 26
FINGERPRINTS = "row_id long, doc_id long, n_words long, hits array<struct<size:int,hash:long,at:int,first:int,words:array<string>>>"


def _bits(hashes: np.ndarray, m: int) -> list[np.ndarray]:
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(m)).astype(np.int64) for i in range(3)]


def _tagged(hashes: np.ndarray, size: int) -> np.ndarray:
    return T.mix(hashes ^ np.uint64(size)) if size < WINDOW else hashes


def winnow(w: T.Words) -> np.ndarray:
    """First words of the kept runs of GRAM words; leftmost of equals; rows never share a run."""
    g = T.grams(w.hash, GRAM)
    span = WINDOW - GRAM + 1
    if len(g) < span:
        return np.zeros(0, np.int64)
    row, best = w.row, T.sliding_min(g, span)
    inside = row[: len(best)] == row[WINDOW - 1 : WINDOW - 1 + len(best)]
    return np.unique(best[inside])


def _item_windows(spark: SparkSession, items: DataFrame) -> DataFrame:
    """Each window of each item: item_id, size, text, the hash of its fingerprint and where that begins."""

    def scan(batches):
        for b in batches:
            out = []
            for c in T.chunks(b.column("text")):
                w = T.words(c, "plain")
                text = [bytes(w.data[i:j]).decode("utf-8", "replace") for i, j in zip(w.start, w.end, strict=True)]
                g = T.grams(w.hash, GRAM)
                for r in range(c.rows):
                    lo, hi = w.bounds[r], w.bounds[r + 1]
                    item = b.column("item_id")[c.first + r].as_py()
                    if lo == hi or item is None:
                        continue
                    if (n := hi - lo) < WINDOW:
                        out.append((str(item), int(n), " ".join(text[lo:hi]), int(_tagged(T.grams(w.hash[lo:hi], n), n)[0].view(np.int64))))
                    for s in range(lo, hi - WINDOW + 1):
                        at = s + int(np.argmin(g[s : s + WINDOW - GRAM + 1]))
                        out.append((str(item), WINDOW, " ".join(text[s : s + WINDOW]), int(g[at].view(np.int64))))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                ["item_id", "size", "window", "hash"],
            )

    return items.select("item_id", "text").mapInArrow(lean(scan), "item_id string, size int, window string, hash long")


def _filter(windows: DataFrame, bits: int) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter (of bounded size) of the items' fingerprints, built where they are; and their sizes below WINDOW."""

    def fill(batches):
        for b in batches:
            h = b.column("hash").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_bits(h, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "mask"])

    words = windows.select("hash").mapInArrow(lean(fill), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    sizes = [r.size for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect()]
    return out, sorted(sizes)


def _passes(bloom: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for at in _bits(h, bits):
        ok &= (bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _fingerprint(docs: DataFrame, bloom: np.ndarray, bits: int, sizes: list[int], row: str | None = None) -> DataFrame:
    """For each document its number of words and those fingerprints that may be an item's, with the words around them."""
    own, carried = [F.col(row).alias("row")] if row else [], ["row"] if row else []
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bloom, task = shared.value, TaskContext.get().partitionId()
        serial = task << 33
        for b in batches:
            ids = b.column("doc_id")
            for c in T.chunks(b.column("text")):
                w = T.words(c, "plain")
                found = []  # (word, size)
                at = winnow(w)
                if len(at):
                    h = T.grams(w.hash, GRAM)[at]
                    ok = _passes(bloom, bits, h)
                    found += [(int(a), WINDOW, int(x)) for a, x in zip(at[ok], h[ok].view(np.int64), strict=True)]
                row = w.row
                for n in sizes:
                    h = _tagged(T.grams(w.hash, n), n)
                    ok = np.flatnonzero(_passes(bloom, bits, h))
                    ok = ok[row[ok] == row[ok + n - 1]]
                    found += [(int(a), n, int(x)) for a, x in zip(ok, h[ok].view(np.int64), strict=True)]
                hits: list[list] = [[] for _ in range(c.rows)]
                for a, n, x in found:
                    r = int(row[a])
                    lo, hi = (max(w.bounds[r], a + GRAM - WINDOW), min(w.bounds[r + 1], a + WINDOW)) if n == WINDOW else (a, a + n)
                    text = [bytes(w.data[w.start[i] : w.end[i]]).decode("utf-8", "replace") for i in range(lo, hi)]
                    hits[r].append({"size": n, "hash": x, "at": a - int(w.bounds[r]), "first": int(lo - w.bounds[r]), "words": text})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(serial, serial + c.rows)),
                        ids.slice(c.first, c.rows).cast(pa.int64()),
                        pa.array(np.diff(w.bounds).astype(np.int64)),
                        pa.array(hits, pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))),
                        *(x.slice(c.first, c.rows) for x in b.columns[2:]),
                    ],
                    ["row_id", "doc_id", "n_words", "hits", *carried],
                )
                serial += c.rows

    return docs.select("doc_id", "text", *own).mapInArrow(lean(scan), FINGERPRINTS + (", row long" if row else ""))


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, filter_bits: int = FILTER_BITS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: row_id, doc_id, n_words; hits: row_id, first, size, window) of ``docs(doc_id, text)`` by ``items(item_id, text)``."""
    prepare(spark)
    windows = materialize(_item_windows(spark, items))
    bloom, sizes = _filter(windows, filter_bits)
    scanned = materialize(_fingerprint(docs, bloom, filter_bits, sizes, row))
    fingerprints = windows.select("size", "hash").distinct()
    candidates = scanned.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    joined = candidates.join(fingerprints, ["size", "hash"], "left_semi")
    # A fingerprint is held by at most 6 windows of its document, a short item's by one.
    start = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("shift")
    extended = (
        joined.filter(F.size("words") >= F.col("size"))
        .select("row_id", "size", "first", "words", start)
        .select("row_id", (F.col("first") + F.col("shift")).alias("first"), "size", F.array_join(F.slice("words", F.col("shift") + 1, F.col("size")), " ").alias("window"))
        .distinct()
    )
    known = windows.select("size", "window").distinct()
    return scanned, extended.join(known, ["size", "window"], "left_semi"), windows


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted), spans (maximal hit runs of words), contaminated.

    ``row`` names a column of longs that tells rows of one id apart; it is then returned as ``row``.
    """
    scanned, found, windows = hits(spark, docs, items, row=row)
    found = materialize(found)
    # Windows of one passage belong to the same items: send the set of items once per document, not once per window.
    sets = windows.select("size", "window", "item_id").distinct().groupBy("size", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    items_of = (
        found.join(sets, ["size", "window"]).select("row_id", "items").distinct().select("row_id", F.explode("items").alias("item")).distinct()
        .groupBy("row_id").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    # Spans: a window opens a span unless an earlier one of its row reaches it.  All windows of a row are its own text.
    runs = found.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("size")).alias("end")))).alias("runs"))
    empty = F.expr("cast(array() as array<struct<first:int,end:int>>)")
    merge = F.aggregate(
        "runs",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    spans = runs.select("row_id", merge.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    return (
        scanned.drop("hits").join(spans, "row_id", "left").join(items_of, "row_id", "left")
        .select(
            "doc_id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("item_ids").cast("long"), F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
            F.coalesce("spans", empty).alias("spans"), F.col("spans").isNotNull().alias("contaminated"),
            *(["row"] if row else []),
        )
    )
