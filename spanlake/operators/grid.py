"""Scores over a grid of window sizes and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from .lists import by_doc
from .metrics import rates


def _checked(grid: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    if any(not 0 <= overlap < size for size, overlap in grid):
        raise ValueError("the overlap is smaller than the window")
    return list(dict.fromkeys(grid))


def clipped_to_windows(lengths: DataFrame, spans: DataFrame, grid: Sequence[tuple[int, int]]) -> DataFrame:
    """(size, overlap, doc, chunk, char_start, start, end, type): spans(doc, start, end, type) as each window of lengths(doc, n) sees them.

    All points of the ``grid`` are taken in one pass; a span's windows follow from its place, so no window is made that
    holds nothing.  Windows are those of ``chunk.token_windows``.
    """
    grid = _checked(grid)
    points = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in grid])).alias("g")
    rows = spans.select("doc", "start", "end", "type").filter("start >= 0 and end > start").join(lengths.select("doc", "n"), "doc").filter("start < n")
    rows = rows.select("*", points).select("doc", "start", F.least("end", "n").alias("end"), "type", "n", "g.*").withColumn("stride", F.col("size") - F.col("overlap"))
    last = F.when(F.col("n") <= F.col("size"), 0).otherwise(F.ceil((F.col("n") - F.col("overlap")) / F.col("stride")) - 1).cast("long")
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("start") - F.col("size")) / F.col("stride")) + 1)
    high = F.least(last, F.floor((F.col("end") - 1) / F.col("stride")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(low, high))).withColumn("at", F.col("chunk") * F.col("stride"))
    start = F.greatest(F.col("start"), F.col("at")) - F.col("at")
    return rows.select("size", "overlap", "doc", "chunk", F.col("at").alias("char_start"), start.alias("start"), (F.least(F.col("end"), F.col("at") + F.col("size")) - F.col("at")).alias("end"), "type")


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, gap: int) -> list[np.ndarray]:
    """Distinct spans of texts, with neighbours of one type within ``gap`` as one; a type below 0 is unknown and joins nothing."""
    order = np.lexsort((kind, end, start, doc))
    doc, start, end, kind = (x[order] for x in (doc, start, end, kind))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (kind[1:] != kind[:-1])][: len(doc)]
    doc, start, end, kind = (x[new] for x in (doc, start, end, kind))
    if not len(doc):
        return [doc, start, end, kind]
    block = np.r_[True, (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] < 0)]
    # The highest end so far in a block: blocks are set apart by more than any end.
    apart = np.cumsum(block) * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + apart) - apart
    first = np.flatnonzero(np.r_[True, block[1:] | (start[1:] > so_far[:-1] + gap)])
    last = np.r_[first[1:], len(doc)] - 1
    return [doc[first], start[first], so_far[last], kind[first]]


def _scored(grid: list[tuple[int, int]], gap: int):
    """Counts of each point of ``grid`` over batches of (n, p, g): a text's lengths, predictions and gold spans."""

    def spans(column: pa.ListArray, types: dict) -> list[np.ndarray]:
        flat = column.flatten()
        names = flat.field("type").to_pylist()
        doc = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        return [doc, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end")), np.array([types[t] for t in names], np.int64)]

    def run(batches):
        for b in batches:
            listed = [b.column(c) for c in "npg"]
            found = {t for x in listed[1:] for t in x.flatten().field("type").unique().to_pylist()} - {None}
            types = {None: -1} | {t: i for i, t in enumerate(sorted(found, key=str.encode))}
            p, g = (spans(x, types) for x in listed[1:])
            n, own = listed[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64), listed[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # Each prediction meets the length of its text.
            each = np.repeat(np.arange(len(p[0])), own[p[0]])
            within = np.arange(len(each)) - np.repeat(np.cumsum(own[p[0]]) - own[p[0]], own[p[0]])
            doc, start, end, kind = (x[each] for x in p)
            total = n[(np.cumsum(own) - own)[doc] + within]
            ok = start < total
            doc, start, end, kind, total = (x[ok] for x in (doc, start, end, kind, total))
            end = np.minimum(end, total)
            rows = []
            for size, overlap in grid:
                stride = size - overlap
                windows = lambda m: np.where(m <= size, 1, -(-(m - overlap) // stride))  # noqa: E731, B023
                low, high = np.maximum(0, (start - size) // stride + 1), np.minimum(windows(total) - 1, (end - 1) // stride)
                count = np.maximum(0, high - low + 1)
                i = np.repeat(np.arange(len(doc)), count)
                at = (np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]) * stride
                made = _merged(doc[i], np.maximum(start[i], at), np.minimum(end[i], at + size), kind[i], gap)
                both = [np.r_[x, y] for x, y in zip(g, made, strict=True)]
                order = np.lexsort((np.r_[np.zeros(len(g[0])), np.ones(len(made[0]))], *both[::-1]))
                # Gold spans come before what equals them; both sides are sets.
                same = np.ones(max(0, len(order) - 1), bool)
                for x in both:
                    same &= x[order][1:] == x[order][:-1]
                tp = int((same & (both[3][order][1:] >= 0)).sum())
                rows.append((size, overlap, int(windows(n).sum()), len(made[0]), tp, len(g[0])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["size", "overlap", "windows", "made", "tp", "all"])

    return run


def grid_scores(lengths: DataFrame, gold: DataFrame, pred: DataFrame, grid: Sequence[tuple[int, int]], gap: int = 0) -> DataFrame:
    """(rank, size, overlap, windows, tp, fp, fn, precision, recall, f1) of each point of ``grid``, best f1 first.

    Predictions(doc, start, end, type) are cut by the windows of texts of lengths(doc, n) tokens, put together again, and
    neighbours of one type within ``gap`` become one; then they are held against the gold spans, strictly, as sets.  Equal
    scores go by size, then overlap.
    """
    grid = _checked(grid)
    bound_batches(lengths.sparkSession)
    usable = lambda rows: rows.select("doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "type").filter("start >= 0 and end > start")
    # A text's spans meet in its row, for all points of the grid; only counts become rows.
    rows = by_doc(n=lengths.filter("n is not null").select("doc", F.col("n").cast("long").alias("n")), p=usable(pred).filter("doc is not null"), g=usable(gold))
    rows = rows.select(F.transform("n", lambda x: x["n"]).alias("n"), "p", F.array_distinct("g").alias("g"))
    counted = rows.mapInArrow(_scored(grid, gap), "size int, overlap int, windows long, made long, tp long, all long")
    sums = counted.groupBy("size", "overlap").agg(*[F.sum(c).alias(c) for c in ("windows", "made", "tp", "all")])
    points = lengths.sparkSession.createDataFrame(grid, "size int, overlap int")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = points.join(sums, ["size", "overlap"], "left").select("size", "overlap", n("windows").alias("windows"), n("tp").alias("tp"), (n("made") - n("tp")).alias("fp"), (n("all") - n("tp")).alias("fn"))
    rows = rows.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("f1"), "size", "overlap")).alias("rank"), "*")
