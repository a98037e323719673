"""Ranked lexical search by bag deduplication.

Documents are cut down to the items' vocabulary: what is left of one is its bag (term numbers and frequencies) and
``m``, which stands for its length.  Documents with equal bag and ``m`` have equal scores for every item, so they are one
class: grouped by a hash, told apart by the bags themselves.  Each class is scored once; the best k classes of an item,
by score and smallest doc_id, hold its best k documents, and only these classes are expanded, by ascending doc_id.

Items go in blocks of a bounded number of (item, term) entries, so what each task holds of them is bounded; each block is
one pass over the documents.  Numbers of documents, terms and document frequencies are counted over all rows, in tasks
first.  A class that holds a third of all documents is aggregated before it is shuffled, and of its members no task
passes on more than k.

A score is an integer: frequent terms are multiplied as doubles where all sums stay below 2^53, else as 64-bit integers.

Null and empty texts, documents or items, have no terms: such documents are never found, such items give no rows.  Rows
of one item_id are one item; rows of one doc_id are ranked each by itself.  Equal scores go by doc_id, null ids last.
Very long texts are one row of a scan, held with some ten bytes for each of theirs.  Empty tables give no rows.  Other
columns are ignored, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .tables import lean, materialize, prepare

#: (item, term) entries of a block of items, about.
ENTRIES = 1 << 18
#: Items scored together, and how many of them must share a term for it to be multiplied densely.
COLUMNS, DENSE = 256, 16
NOBODY = np.iinfo(np.int64).max


def _terms(chunk: T.Chunk) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of a chunk, and where each row's terms begin."""
    data = T.fold_table()[chunk.data]
    inside = T.word_table("plain")[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[chunk.offs[:-1][np.diff(chunk.offs) > 0]] = False
    start = np.flatnonzero(inside & ~before)
    kept = np.r_[0, np.cumsum(inside)]
    offs = np.r_[kept[start], kept[-1]].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offs), pa.py_buffer(data[inside])]), np.searchsorted(start, chunk.offs)


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) of ``items(item_id, text)``."""

    def scan(batches):
        for b in batches:
            for c in T.chunks(b.column("text")):
                terms, bounds = _terms(c)
                rows = np.repeat(np.arange(c.rows), np.diff(bounds)) + c.first
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(rows)), terms.cast(pa.binary())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(lean(scan), f"item_id {kind}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, bag): the number of terms, and (term number, frequency) pairs of the ``vocabulary``, of rows with terms."""
    terms = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches):
        words = terms.value
        for b in batches:
            for c in T.chunks(b.column("text")):
                found, bounds = _terms(c)
                at = pc.index_in(found, value_set=words).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(c.rows, dtype=np.int64), np.diff(bounds))[at >= 0]
                pairs, tf = np.unique(row * len(words) + at[at >= 0], return_counts=True)
                entries = np.c_[pairs % max(1, len(words)), tf].astype("<u4")
                offs = np.searchsorted(pairs // max(1, len(words)), np.arange(c.rows + 1)) * 8
                bag = pa.Array.from_buffers(pa.binary(), c.rows, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(entries.tobytes())])
                n = pa.array(np.diff(bounds).astype(np.int64))
                out = pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.rows).cast(pa.int64()), n, bag], ["doc_id", "n", "bag"])
                yield out.filter(pc.greater(n, 0))

    return docs.select("doc_id", "text").mapInArrow(lean(scan), "doc_id long, n long, bag binary")


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and (term, frequency) of a column of bags."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, 2).astype(np.int64)


def document_frequencies(bagged: DataFrame, terms: int) -> np.ndarray:
    """In how many rows each term occurs; counted in tasks first."""

    def count(batches):
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(_entries(b.column("bag"))[1][:, 0], minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    found = bagged.select("bag").mapInArrow(lean(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Scorer:
    """The scores of bags for a block of items, ``COLUMNS`` items at a time."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weights: np.ndarray, items: int):
        self.weights, self.slices = weights, []
        for lo in range(0, items, COLUMNS):
            mine = (item >= lo) & (item < lo + COLUMNS)
            t, i = term[mine], item[mine] - lo
            order = np.lexsort((i, t))
            t, i = t[order], i[order]
            each = np.bincount(t, minlength=len(weights))
            dense = np.full(len(weights), -1)
            often = np.flatnonzero(each >= DENSE)
            dense[often] = np.arange(len(often))
            # No sum exceeds this: a term counts for less than 1,000,000 times its weight.
            most = float(np.bincount(i, weights[t] * 1e6, minlength=1).max(initial=0))
            table = np.zeros((len(often), min(COLUMNS, items - lo)), np.float64 if most < 2**53 else np.int64)
            table[dense[t[dense[t] >= 0]], i[dense[t] >= 0]] = 1
            rare = dense[t] < 0
            starts = np.searchsorted(t[rare], np.arange(len(weights) + 1))
            self.slices.append((lo, dense, table, starts, i[rare]))

    def score(self, row: np.ndarray, entries: np.ndarray, m: np.ndarray):
        """(first item, scores of each bag for each item of a slice)."""
        term, tf = entries.T
        part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        for lo, dense, table, starts, items in self.slices:
            often = dense[term] >= 0
            a = np.zeros((len(m), len(table)), table.dtype)
            a[row[often], dense[term[often]]] = part[often]
            out = (a @ table).astype(np.int64)
            count = starts[term + 1] - starts[term]
            each = np.repeat(np.arange(len(term)), count)
            at = items[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + starts[term[each]]]
            np.add.at(out, (row[each], at), part[each])
            yield lo, out


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (item, score, low, class) columns, the k best rows of each item."""
    order = np.lexsort((found[2], -found[1], found[0]))
    found = [x[order] for x in found]
    first = np.searchsorted(found[0], found[0])
    keep = np.arange(len(first)) - first < k
    return [x[keep] for x in found]


def best_classes(classes: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """(item, score, low, class): each item's k best of ``classes(class, m, bag, low)``, by score and smallest doc_id."""
    shared = classes.sparkSession.sparkContext.broadcast(scorer)

    def scan(batches):
        best = [np.zeros(0, np.int64) for _ in range(4)]
        for b in batches:
            if not b.num_rows:
                continue
            row, entries = _entries(b.column("bag"))
            low, number = b.column("low").fill_null(NOBODY).to_numpy(), b.column("class").to_numpy()
            for lo, scores in shared.value.score(row, entries, b.column("m").to_numpy()):
                floor = np.ones(scores.shape[1], np.int64)
                if len(scores) > k:
                    floor = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                r, i = np.nonzero(scores >= floor)
                best = _best([np.concatenate(x) for x in zip(best, (i + lo, scores[r, i], low[r], number[r]), strict=True)], k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["item", "score", "low", "class"])

    found = classes.select("m", "bag", "low", "class").mapInArrow(lean(scan), "item long, score long, low long, class long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "low")))
    return ranked.filter(F.col("place") <= k).select("item", "score", "class")


def search_block(docs: DataFrame, entries: pa.Table, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of the items in ``entries(item, term)``, whose numbers begin at 0."""
    vocabulary = entries.column("term").unique().cast(pa.large_binary()).sort()
    bagged = materialize(bags(docs, vocabulary))
    total = bagged.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    df = document_frequencies(bagged, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * total.N + 2) / (2 * df + 1))).astype(np.int64)
    item = entries.column("item").to_numpy()
    term = pc.index_in(entries.column("term").cast(pa.large_binary()), value_set=vocabulary).to_numpy()
    scorer = Scorer(item, term, weights, int(item.max()) + 1)

    known = bagged.filter(F.length("bag") > 0).withColumn("m", F.expr(f"10 + (90 * n * {total.N}L) div {max(1, total.L)}L")).withColumn("key", F.xxhash64("m", "bag"))
    classes = materialize(known.groupBy("key", "m", "bag").agg(F.min("doc_id").alias("low")).withColumn("class", F.monotonically_increasing_id()))
    winners = materialize(best_classes(classes, scorer, k))
    # At most k classes of each item of the block: of a bounded size.
    wanted = materialize(classes.join(F.broadcast(winners.select("class").distinct()), "class").select("class", "key", "m", "bag"))
    near = known.join(F.broadcast(wanted.select("key").distinct()), "key", "left_semi")
    by_id = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last())
    near = near.withColumn("place", F.row_number().over(by_id("key", "m", "bag"))).filter(F.col("place") <= k).drop("place", "n")
    members = winners.join(near.join(wanted, ["key", "m", "bag"]).select("class", "doc_id"), "class")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return members.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs(doc_id, text)`` with the highest scores above 0 for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    pairs = materialize(item_terms(items))
    named = materialize(pairs.select("item_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    blocks = max(1, -(-pairs.count() // (ENTRIES // 2)))
    numbered = pairs.select(F.col("item_id").alias("id"), "term").join(named, F.col("id").eqNullSafe(F.col("item_id"))).select("number", "term")
    out = named.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for block in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).toArrow()
        if not len(part):
            continue
        numbers, item = np.unique(part.column("number").to_numpy(), return_inverse=True)
        found = search_block(docs, pa.table({"item": pa.array(item.astype(np.int64)), "term": part.column("term")}), k)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(numbers))), "number": pa.array(numbers)}))
        out = out.union(found.join(F.broadcast(names), "item").join(named, "number").select("item_id", "rank", "doc_id", "score"))
    return out
