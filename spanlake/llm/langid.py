"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else counts as a space; runs of 1 to 3 characters are hashed into buckets.  Counts come
from every labelled training row.  The matrix of log-probabilities has a fixed number of buckets and one column for
each language, of which there may be ``MAX_LANGUAGES``; it is broadcast and rows are scored in numpy, whole texts.

A text that is null or has no letter is ``und`` with score 0.  Without any training row all texts are.  Ties go to the
language first in order.  Every row gives a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as T
from .tables import lean, prepare

BUCKETS, LONGEST, SMOOTHING, MAX_LANGUAGES = 1 << 17, 3, 0.02, 1000
UNKNOWN = "und"


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, what it counts as, and whether it is a letter."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    fold = np.full(0x110000, 32, np.uint32)
    at = np.flatnonzero(letter)
    fold[at] = [ord(x) if len(x := chr(i).lower()) == 1 else i for i in at.tolist()]
    return fold, letter


def _scan(c: T.Chunk):
    """Of a chunk: the start of each row in characters, whether it has a letter, and for each n the buckets and where rows begin in them."""
    fold, letter = _characters()
    points = np.frombuffer(c.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.r_[0, np.cumsum((c.data & 0xC0) != 0x80)]
    offs = heads[c.offs]
    some = np.r_[0, np.cumsum(letter[points])]
    x = fold[points]
    grams = []
    row = np.repeat(np.arange(c.rows, dtype=np.int32), np.diff(offs))
    for n in range(1, LONGEST + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ x[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ok = row[:m] == row[n - 1 : n - 1 + m]
        grams.append((h[ok] & np.uint32(BUCKETS - 1), row[:m][ok]))
    return some[offs[1:]] > some[offs[:-1]], grams


def _sum_rows(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by their ascending row numbers."""
    out = np.zeros((rows, values.shape[1]))
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    if len(starts):
        out[row[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages of ``docs(text, lang)``, log-probabilities of each bucket (buckets x languages) and of each language."""
    labelled = docs.filter("lang is not null").select("text", "lang")
    found = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = [r.lang for r in found]

    def count(batches):
        total, number = np.zeros((len(langs), BUCKETS), np.int64), {x: i for i, x in enumerate(langs)}
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for c in T.chunks(b.column("text")):
                own = lang[c.first : c.first + c.rows]
                for h, row in _scan(c)[1]:
                    of = own[row]
                    for i in np.unique(own):
                        total[i] += np.bincount(h[of == i], minlength=BUCKETS)
        for i, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        t = labelled.mapInArrow(lean(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[t.column("bucket").to_numpy(), t.column("lang").to_numpy()] = t.column("n").to_numpy()
    logs = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS))
    n = np.array([r["count"] for r in found], np.float64)
    return langs, logs, np.log(n / n.sum()) if langs else n


def predictor(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray]):
    """A column function from texts to (lang_pred, score) by ``train``'s model; the texts themselves stay where they are."""
    langs, logs, prior = model
    shared = spark.sparkContext.broadcast((logs, prior))
    # A chunk's rows of log-probabilities take some 16 MB.
    size = min(T.CHUNK, max(1 << 16, (2 << 20) // max(1, len(langs))))

    def of(texts: pa.Array) -> pa.Array:
        logs, prior = shared.value
        pred, score = [], []
        for c in T.chunks(texts, size):
            known, grams = _scan(c)
            if not langs:
                pred += [UNKNOWN] * c.rows
                score.append(np.zeros(c.rows))
                continue
            s = np.tile(prior, (c.rows, 1))
            for h, row in grams:
                for lo in range(0, len(h), size):  # a text longer than a chunk
                    s += _sum_rows(logs[h[lo : lo + size]], row[lo : lo + size], c.rows)
            best = s.argmax(1)
            p = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            pred += [langs[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            score.append(np.where(known, p, 0.0))
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], ["lang_pred", "score"])

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(lambda arrays: map(of, arrays))(texts)

    return predict.asNondeterministic()  # or a filter on the prediction would run it a second time


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """One row per row of ``docs``: its columns, lang_pred and score (in place of columns of these names); learns from rows where ``training``."""
    spark = docs.sparkSession
    prepare(spark)
    predict = predictor(spark, train(docs.filter(training)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    name = next(n for n in (f"found{i}" for i in range(len(kept) + 1)) if n not in kept)
    return docs.select(*kept, predict("text").alias(name)).select(*kept, f"{name}.lang_pred", f"{name}.score")
