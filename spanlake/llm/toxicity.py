"""Toxicity: a factorization machine over hashed terms.

A term is a word of letters and digits, hashed to 64 bits; a text's features are its distinct terms.  The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: the weights add up single terms, the factors learn pairs, such as an
insult with the mention of a group.  It is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of the id
(fewer in all: all of them), with AdaGrad in one task.  A term has parameters if
it deviates by itself or as one of a pair: a term of at least ``MIN_ROWS`` rows whose share of toxic rows is off the
sample's, or one of the ``PAIR_TERMS`` most frequent terms that changes what another of them says.  The others occur with
and without the label alike; in a sample they only fit noise.  Scoring covers every row and its whole text.

Null and empty texts have no terms and score sigmoid(b).  Without labelled rows the score is 0.  Of a document with
several labels the highest counts.  Every row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .tables import materialize, prepare

SAMPLE, MIN_ROWS, FACTORS = 20_000, 4, 4
#: A term has parameters if its rows' share of toxic ones is so many standard deviations off the whole sample's.
DEVIATION = 3.0
#: Frequent terms of the sample whose pairs are looked at, rows that a pair has at least, and by how many standard
#: deviations the pair's share of toxic rows is off what its two terms add up to.
PAIR_TERMS, PAIR_ROWS, PAIR_DEVIATION = 1024, 8, 8.0
EPOCHS, BATCH_ROWS, RATE, DECAY = 12, 256, 0.1, 0.05
#: Parts of the sample; each is scored by a machine fitted on the others, and these scores set the bias.
FOLDS = 4
#: What a false alarm costs, in hits, as rates.
ALARM = 2.0


def terms(texts: pa.Array):
    """(row, its distinct term hashes, sorted) in order."""
    for c in T.chunks(texts):
        w = T.words(c, "plain")
        for r in range(c.rows):
            yield np.unique(w.hash[w.bounds[r] : w.bounds[r + 1]])


class Machine:
    """Terms in order, their weights and factors, and the bias."""

    def __init__(self, term: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.term, self.weight, self.factor, self.bias = term, weight, factor, bias

    def places(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The known terms' places, and their rows."""
        if not len(self.term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.term, flat), len(self.term) - 1)
        ok = self.term[at] == flat
        return at[ok], row[ok]

    def logits(self, at: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        z = self.bias + np.bincount(row, self.weight[at], minlength=rows)
        sums = np.empty((rows, self.factor.shape[1]))
        for f in range(self.factor.shape[1]):
            v = self.factor[at, f]
            sums[:, f] = np.bincount(row, v, minlength=rows)
            z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, v * v, minlength=rows))
        return z, sums


def interacting(which: np.ndarray, row: np.ndarray, count: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each term, whether with another frequent one it deviates from the sum of both.

    ``which`` and ``row`` are the terms' occurrences, by row; ``count`` the rows of each term.
    """
    out = np.zeros(len(count), bool)
    often = np.lexsort((np.arange(len(count)), -count))[:PAIR_TERMS]
    often = np.sort(often[count[often] >= PAIR_ROWS])
    if len(often) < 2:
        return out
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    ok = place[which] >= 0
    at, row = place[which[ok]], row[ok]
    n11, p11 = np.zeros((len(often), len(often))), np.zeros((len(often), len(often)))
    for lo in range(0, len(labels), 4096):
        own = labels[lo : lo + 4096] > 0
        a, b = np.searchsorted(row, (lo, lo + len(own)))
        x = np.zeros((len(own), len(often)), np.float32)
        x[row[a:b] - lo, at[a:b]] = 1
        n11 += x.T @ x
        p11 += x[own].T @ x[own]
    rows, toxic = len(labels), labels.sum()
    n, p = np.diag(n11), np.diag(p11)
    ns = n11, n[:, None] - n11, n[None] - n11, rows - n[:, None] - n[None] + n11
    ps = p11, p[:, None] - p11, p[None] - p11, toxic - p[:, None] - p[None] + p11
    least = np.minimum.reduce(ns)
    both, one, other, neither = (y / np.maximum(x, 1) for x, y in zip(ns, ps, strict=True))
    share = toxic / rows
    spread = np.sqrt(max(share * (1 - share), 1e-9) * sum(1 / np.maximum(x, 1) for x in ns))
    out[often] = ((np.abs(both - one - other + neither) >= PAIR_DEVIATION * spread) & (least >= PAIR_ROWS)).any(1)
    return out


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss, by rows in a fixed random order; toxic rows weigh as much as the others in all."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    term, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    share = labels.mean()
    off = np.abs(np.bincount(which, labels[row], minlength=len(term)) - share * count) / np.sqrt(np.maximum(count * share * (1 - share), 1e-9))
    term = term[(count >= MIN_ROWS) & (off >= DEVIATION) | interacting(which, row, count, labels)]
    rng = np.random.default_rng(7)
    m = Machine(term, np.zeros(len(term)), rng.normal(0, 0.01, (len(term), FACTORS)), 0.0)
    at, row = m.places(flat, row)
    bounds = np.searchsorted(row, np.arange(len(sets) + 1))
    positive = max(1, int(labels.sum()))
    m.bias = float(np.log(positive / max(1, len(labels) - positive)))
    seen_w, seen_v, seen_b = np.full(len(term), 1e-8), np.full((len(term), FACTORS), 1e-8), 1e-8
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for lo in range(0, len(order), BATCH_ROWS):
            own = order[lo : lo + BATCH_ROWS]
            n = bounds[own + 1] - bounds[own]
            local = np.repeat(np.arange(len(own)), n)
            x = at[np.repeat(bounds[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            z, sums = m.logits(x, local, len(own))
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]
            used, where = np.unique(x, return_inverse=True)
            g = np.bincount(where, miss[local], minlength=len(used)) / len(own) + DECAY / len(own) * m.weight[used]
            seen_w[used] += g * g
            m.weight[used] -= RATE * g / np.sqrt(seen_w[used])
            for f in range(FACTORS):
                v = m.factor[x, f]
                g = np.bincount(where, miss[local] * (sums[local, f] - v), minlength=len(used)) / len(own) + DECAY / len(own) * m.factor[used, f]
                seen_v[used, f] += g * g
                m.factor[used, f] -= RATE * g / np.sqrt(seen_v[used, f])
            g = miss.mean()
            seen_b += g * g
            m.bias -= RATE * g / np.sqrt(seen_b)
    return m


def cut(z: np.ndarray, labels: np.ndarray) -> float:
    """Where z parts the labels best (rate of hits less the cost of false alarms): the middle of the widest gap of those equally good."""
    if labels.min() == labels.max() or not z.any():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    hits = (y.sum() - np.cumsum(y)) / y.sum()
    alarms = ((1 - y).sum() - np.cumsum(1 - y)) / (1 - y).sum()
    good = (hits - ALARM * alarms)[:-1]
    gap = np.where(good >= good.max() - 1e-12, np.diff(z), -1)
    i = int(gap.argmax())
    return float(z[i] + z[i + 1]) / 2


def fit_and_calibrate(sets: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Fit on all rows; the bias is moved so that 0.5 parts rows best that the machine hasn't seen."""
    fold, z = np.arange(len(sets)) % FOLDS, np.zeros(len(sets))
    for f in range(FOLDS) if len(sets) >= 2 * FOLDS else ():
        m = fit([x for x, k in zip(sets, fold, strict=True) if k != f], labels[fold != f])
        own = [x for x, k in zip(sets, fold, strict=True) if k == f]
        at, row = m.places(np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]))
        z[fold == f] = m.logits(at, row, len(own))[0]
    m = fit(sets, labels)
    m.bias -= cut(z, labels)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Fit on ``labels(doc_id, toxic)`` joined with ``docs(doc_id, text)``; at most ``sample`` rows, about."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(1, total))))
    chosen = materialize(known.filter(share))
    # Bounded by the sample: broadcasting it leaves the documents where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.tobytes() for t in terms(b.column("text"))], pa.binary()), b.column("toxic").cast(pa.int32())], ["doc_id", "terms", "toxic"])

    def learn(batches):
        got = [(i, x, y) for b in batches for i, x, y in zip(b.column("doc_id").to_pylist(), b.column("terms").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
        if got:
            got.sort()
            m = fit_and_calibrate([np.frombuffer(x, np.uint64) for _, x, _ in got], np.array([float(y > 0) for *_, y in got]))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.term.tobytes(), m.weight.tobytes(), m.factor.tobytes())] + [pa.array([m.bias])], ["term", "weight", "factor", "bias"])

    found = rows.mapInArrow(features, "doc_id long, terms binary, toxic int").repartition(1).mapInArrow(learn, "term binary, weight binary, factor binary, bias double").collect()
    if not found:
        return None
    r = found[0]
    return Machine(np.frombuffer(r.term, np.uint64), np.frombuffer(r.weight), np.frombuffer(r.factor).reshape(-1, FACTORS), r.bias)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scan(batches):
        m = shared.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in T.chunks(b.column("text")) if m is not None else ():
                w = T.words(c, "plain")
                at, row = m.places(w.hash, w.row)
                pair = np.unique(row * (len(m.term) + 1) + at)  # each term once
                z, _ = m.logits(pair % (len(m.term) + 1), pair // (len(m.term) + 1), c.rows)
                out[c.first : c.first + c.rows] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, score double")
