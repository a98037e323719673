"""Katz backoff language model over bigrams.

``P(w | v)`` is the Good-Turing discounted count of (v, w) over the count of v where (v, w) occurs in training, and
else ``alpha(v) * P(w)``, with alpha such that the whole sums to one; ``P(w) = (c + 0.1) / (N + 0.1 (V + 1))``, which
keeps a share for all unknown words.  Where discounting leaves nothing for unseen words, v counts once more.

Documents are held as batches of token numbers.  Counts of words and of bigrams are summed by key over all batches in
shards and handed back to those that asked; then the batches that own a bigram add up what its context gives to seen
words, and these sums go the same way.  Every token is then scored where its text is: no table is broadcast, and each
bigram travels once per batch, whatever its frequency.

Null and empty texts are the end token alone.  Repeated rows each count and each give a row.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textscan as T
from .batches import gather, pack, unpack, with_replies
from .tables import bucketed, lean, materialize, prepare

ADDED = 0.1
#: Text of a batch: its tokens and bigrams take some 50 times as much memory in a task.
BATCH_BYTES = 4 << 20
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Slopes of the counts of counts by count, as logarithms: of Zipf's law, and the flattest that leaves something to discount.
ZIPF, FLATTEST = -2.0, -1.05
START, END = (int(x) for x in T.mix(np.array([11, 13], np.uint64)))
BATCH = "batch long, size long, ids binary, nulls binary, held binary, sizes binary, vocab binary, tokens binary"


def _make_batch(number: int, docs: pa.Table) -> pa.RecordBatch:
    hashes, sizes, total = [], [], 0
    for c in T.chunks(docs.column("text").combine_chunks()):
        w = T.words(c, "spaced")
        n = np.diff(w.bounds)
        out = np.full(len(w.hash) + c.rows, END, np.uint64)
        out[np.arange(len(w.hash)) + w.row] = w.hash
        hashes.append(out)
        sizes.append(n + 1)
        total += len(c.data)
    vocab, tokens, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which compress
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ids = docs.column("doc_id").cast(pa.int64())
    cols = [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), docs.column("held_out").to_numpy(), np.concatenate(sizes).astype(np.int32), vocab[order]]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([total], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in cols), pa.array([pack(np.ascontiguousarray(place[tokens].view(np.uint8).reshape(-1, 4).T))], pa.binary())],
        ["batch", "size", "ids", "nulls", "held", "sizes", "vocab", "tokens"],
    )


class Batch:
    """The tokens and distinct bigrams of a batch; word number -1, the last, is the start of a document."""

    def __init__(self, r: dict):
        self.sizes, self.held = unpack(r["sizes"], np.int32), unpack(r["held"], bool)
        self.vocab = np.r_[unpack(r["vocab"], np.uint64), np.uint64(START)]
        self.token = np.ascontiguousarray(unpack(r["tokens"], np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)

    def bigrams(self) -> None:
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = len(self.vocab) - 1
        pair, self.pair_of = np.unique(before.astype(np.int64) * len(self.vocab) + self.token, return_inverse=True)
        self.left, self.right = pair // len(self.vocab), pair % len(self.vocab)
        self.key = T.mix(self.vocab[self.left] * np.uint64(T.BASE) + T.mix(self.vocab[self.right]))

    def counts(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.train], minlength=n)


def _good_turing(n: list[float], k: int) -> np.ndarray | None:
    """Discounts of counts 0..k from the counts of counts ``n``, None unless all of them lie between 0 and 1."""
    if not all(n[1:]) or (share := (k + 1) * n[k + 1] / n[1]) >= 1:
        return None
    d = np.array([1.0, *(((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) for r in range(1, k + 1))])
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else None


def discounts(count_of: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts of counts 0..k; counts above keep all.

    Where counts of counts are missing, or give no discount, they are smoothed by a line through the logarithms of those
    there are, no flatter than ``FLATTEST``; of fewer than two, by the slope of Zipf's law.  All discounts then lie
    between 0 and 1.
    """
    n = [float(count_of.get(r, 0)) for r in range(k + 2)]
    found = _good_turing(n, k)
    if found is None:
        seen = [r for r in range(1, k + 2) if n[r]]
        slope = float(np.polyfit(np.log(seen), np.log([n[r] for r in seen]), 1)[0]) if len(seen) > 1 else ZIPF
        found = _good_turing([0.0, *(float(r) ** min(slope, FLATTEST) for r in range(1, k + 2))], k)
    return found


COUNT, OWNED, SUMS = [("n", "<u4")], [("n", "<u4"), ("owner", "?")], [("seen", "<f8"), ("low", "<f8")]


def _ask(batched: DataFrame, shards: int, bigrams: bool) -> DataFrame:
    def ask(rows):
        for b in rows:
            for r in b.to_pylist():
                x = Batch(r)
                if bigrams:
                    x.bigrams()
                    keys, n = x.key, x.counts(x.pair_of, len(x.key))
                else:
                    keys, n = x.vocab[:-1], x.counts(x.token, len(x.vocab) - 1)
                yield X.requests(r["batch"], keys, n.astype("<u4").view(COUNT), shards)

    return batched.mapInArrow(lean(ask), X.REQUEST)


def _count_of_counts(replies: DataFrame, top: int) -> DataFrame:
    """(r, keys, tokens): keys counted r times; r above ``top`` as top + 1."""

    def scan(rows):
        for b in rows:
            for v in b.column("vals").to_pylist():
                x = unpack(v, OWNED)
                n = x["n"][x["owner"]].astype(np.int64)
                r = np.minimum(n, top + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(top + 2)), pa.array(np.bincount(r, minlength=top + 2)), pa.array(np.bincount(r, n, minlength=top + 2).astype(np.int64))], ["r", "keys", "tokens"])

    return replies.mapInArrow(lean(scan), "r long, keys long, tokens long").groupBy("r").agg(F.sum("keys").alias("keys"), F.sum("tokens").alias("tokens"))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score ``docs(doc_id, text)`` by a model of those that are not ``held_out``.

    One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (by words alone), score, both log10.
    """
    prepare(docs.sparkSession)
    batched = bucketed(gather(docs.withColumn("held_out", held_out), ["doc_id", "text", "held_out"], _make_batch, BATCH, BATCH_BYTES), "batch")
    size = batched.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    word_shards, pair_shards = X.shard_count(size, 32 << 20), X.shard_count(size)
    columns = ["batch", "held", "sizes", "vocab", "tokens"]
    words = materialize(X.sum_by_key(_ask(batched.select(columns), word_shards, False), COUNT, OWNED))
    pairs = materialize(X.sum_by_key(_ask(batched.select(columns), pair_shards, True), COUNT, OWNED))
    known = _count_of_counts(words, 0).filter("r > 0").agg(F.coalesce(F.sum("keys"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    vocabulary, tokens = int(known[0]), int(known[1])
    d = discounts({r.r: r.keys for r in _count_of_counts(pairs, DISCOUNTED + 1).collect()})

    def held(r: dict):
        """Word counts (as contexts too), word probabilities and bigram counts of a batch."""
        x = Batch(r)
        x.bigrams()
        n = X.answers(r["words"], x.vocab[:-1], word_shards, OWNED)["n"].astype(np.float64)
        p = (n + ADDED) / (tokens + ADDED * (vocabulary + 1))
        end = np.flatnonzero(x.vocab[:-1] == np.uint64(END))
        context = np.r_[n, n[end]]  # as many starts as ends
        both = X.answers(r["pairs"], x.key, pair_shards, OWNED)
        return x, n, p, context, both["n"].astype(np.int64), both["owner"]

    def kept_count(n: np.ndarray) -> np.ndarray:
        return np.where(n <= DISCOUNTED, d[np.minimum(n, DISCOUNTED)], 1.0) * n

    def ask_sums(rows):
        for b in rows:
            for r in b.to_pylist():
                x, _, p, context, n, owner = held(r)
                own = owner & (n > 0)
                vals = np.zeros(len(x.vocab), SUMS)
                vals["seen"] = np.bincount(x.left[own], kept_count(n[own]), minlength=len(x.vocab))
                vals["low"] = np.bincount(x.left[own], p[x.right[own]], minlength=len(x.vocab))
                yield X.requests(r["batch"], x.vocab, vals, word_shards)

    def ready(source: DataFrame) -> DataFrame:
        return with_replies(with_replies(source, words, "words"), pairs, "pairs")

    sums = X.sum_by_key(ready(batched.select(columns)).mapInArrow(lean(ask_sums), X.REQUEST), SUMS, SUMS)

    def finish(rows):
        unknown = ADDED / (tokens + ADDED * (vocabulary + 1))
        for b in rows:
            for r in b.to_pylist():
                x, c, p, context, n, _ = held(r)
                s = X.answers(r["sums"], x.vocab, word_shards, SUMS)
                total = np.where(s["seen"] >= context - 1e-9, context + 1, context)
                spare = np.maximum(1 - s["low"], unknown)
                alpha = np.where(context > 0, (1 - s["seen"] / total) / spare, 1.0)
                low = np.log10(p)
                with np.errstate(divide="ignore"):
                    by_pair = np.where(n > 0, np.log10(kept_count(n) / total[x.left]), np.log10(alpha[x.left]) + low[x.right])
                add = lambda v: np.add.reduceat(v, x.first)  # noqa: E731  every document has its end token
                rows_out = len(x.sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unpack(r["ids"], np.int64), mask=unpack(r["nulls"], bool)),
                        pa.array(x.held),
                        pa.array(x.sizes.astype(np.int64)),
                        pa.array(add((c > 0)[x.token].astype(np.int64))),
                        pa.array(np.full(rows_out, tokens, np.int64)),
                        pa.array(add(low[x.token])),
                        pa.array(add(by_pair[x.pair_of])),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return with_replies(ready(batched), sums, "sums").mapInArrow(lean(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
