"""Cosines of blocks of vectors, with the roundings of a sum term by term."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Score of pairs that have none, below all cosines; what is below the best that isn't known yet.
NONE, BELOW = -8.0, -9.0
MILLIONTH = Decimal("0.000001")
#: Lengths between these neither vanish nor overflow in products.
PLAIN = 1e-140, 1e140
BLOCK = ("ids", "sizes", "data")


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up at six places of the shortest decimal, as Spark's round; what lies near a half goes through decimals."""
    size = np.abs(x) * 1e6
    out = np.copysign(np.floor(size + 0.5) / 1e6, x) + 0.0
    near = np.abs(size - np.floor(size) - 0.5) < 1e-4
    out[near] = [float(Decimal(repr(float(v))).quantize(MILLIONTH, ROUND_HALF_UP)) for v in x[near]]
    return out + 0.0


def lengths(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for column in np.ascontiguousarray(a.T):
        out += column * column
    return np.sqrt(out)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow on (n, rows): each block's ids in order, sizes (-1: null, or holds nulls) and components as bytes."""
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            flat = one.column("rows").flatten()
            e, ids = flat.field("embedding"), flat.field("vec_id")
            holes, x = np.r_[0, np.cumsum(e.values.is_null().to_numpy(zero_copy_only=False))], e.values.to_numpy(zero_copy_only=False)
            at = e.offsets.to_numpy()
            lost = e.is_null().to_numpy(zero_copy_only=False) | (holes[at[1:]] > holes[at[:-1]])
            order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            data = b"".join(x[at[j] : at[j + 1]].tobytes() for j in order if not lost[j])
            columns = one.column("n"), _list(ids.take(pa.array(order))), _list(pa.array(np.where(lost, -1, np.diff(at))[order], pa.int32())), pa.array([data], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), ["n", *BLOCK])


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _read(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A block's ids, and by their length the places and components of vectors."""
    ids, sizes, data = (batch.column(f"{name}_{c}")[0] for c in BLOCK)
    sizes, x = sizes.values.to_numpy(), np.frombuffer(data.as_buffer(), kind)
    ends, found = np.cumsum(np.maximum(sizes, 0)), {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        found[n] = at, (x.reshape(-1, n) if len(at) * n == len(x) else x[ends[at, None] - n + np.arange(n)]).astype(np.float64)
    return ids.values.to_numpy(zero_copy_only=False), found


def _own(qid: np.ndarray, vid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of places) with one id; ``vid`` is sorted."""
    a, b = np.searchsorted(vid, qid, "left"), np.searchsorted(vid, qid, "right")
    i = np.repeat(np.arange(len(qid)), b - a)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(b - a) - b, b - a)


def _near(q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, least: np.ndarray, k: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors that can be among a query's ``k`` best, and beyond the score ``least`` that it has.

    Products are in single precision; what a pair may lose by it and by rounding stays within ``loss``.  The k-th largest
    of the largest products of some groups is a bound of the k-th best.
    """
    loss, groups = (q.shape[1] + 8) * 2.0**-23 + 1e-6, max(64, 8 * k)
    columns = np.zeros((q.shape[1], -(-len(v) // groups) * groups), np.float32)
    columns[:, : len(v)] = v.T
    room = np.empty((min(step, len(q)), columns.shape[1]), np.float32)
    for a in range(0, len(q), step):
        s = np.matmul(q[a : a + step], columns, out=room[: len(q) - a])
        s[:, len(v) :] = s[_own(qid[a : a + step], vid)] = BELOW
        cells = s.reshape(len(s), -1, groups)
        top = cells.max(axis=1)
        low = np.maximum(least[a : a + step], np.partition(top, groups - k, axis=1)[:, groups - k] - loss)
        low = np.maximum(low - loss, -2.0).astype(np.float32)
        i, g = np.nonzero(top >= low[:, None])
        at, j = np.nonzero(cells[i, :, g] >= low[i, None])
        yield i[at] + a, j * groups + g[at]


def _exact(q: np.ndarray, v: np.ndarray, ql: np.ndarray, vl: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Scores of pairs (i, j); terms are added in order, so that equal vectors have equal sums in any block."""
    out = np.full(len(i), NONE)
    qs, vs = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    for a in range(0, len(i), step):
        x, y = i[a : a + step], j[a : a + step]
        s = np.zeros(len(x))
        with np.errstate(all="ignore"):
            for c, d in zip(qs, vs, strict=True):
                s += c[x] * d[y]
            s /= vl[y] * ql[x]
        good = np.isfinite(s)
        out[a : a + step][good] = rounded(s[good])
    return out


def _met(q: np.ndarray, v: np.ndarray, qid: np.ndarray, vid: np.ndarray, least: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of pairs of vectors of one length, the ``k`` best of each query among them."""
    with np.errstate(all="ignore"):
        ql, vl = lengths(q), lengths(v)
    qp, vp = (np.flatnonzero((x > PLAIN[0]) & (x < PLAIN[1])) for x in (ql, vl))
    units = [(x[p] / n[p, None]).astype(np.float32) for x, n, p in ((q, ql, qp), (v, vl, vp))]
    pairs = [(qp[i], vp[j]) for i, j in _near(*units, qid[qp], vid[vp], least[qp], k, step)] if len(vp) else []
    # Lengths beyond these bounds are rare: such vectors meet all others.  Without a length there is no score.
    live = [x[~(n[x] == 0) & ~np.isnan(n[x])] for x, n in ((np.arange(len(q)), ql), (np.arange(len(v)), vl))]
    odd = [np.setdiff1d(x, p) for x, p in zip(live, (qp, vp), strict=True)]
    for a, b in ((live[0], odd[1]), (odd[0], vp)):
        pairs.append((np.repeat(a, len(b)), np.tile(b, len(a))))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    i, j = (x[qid[i] != vid[j]] for x in (i, j))
    return i, j, _exact(q, v, ql, vl, i, j)


def _best(place: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each place, ties to the smaller id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, place))
    place = place[order]
    first = np.arange(len(place)) - np.searchsorted(place, place, "left") < k
    return place[first], ids[order][first], score[order][first]


def _least(n: int, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each of ``n`` places."""
    out, last = np.full(n, BELOW), np.searchsorted(place, np.arange(n), "left") + k - 1
    full = np.bincount(place, minlength=n) == k
    out[full] = score[last[full]]
    return out


def best_of(k: int, kind: str, step: int = 256) -> Callable[[Iterator], Iterator]:
    """For mapInArrow on pairs of blocks: the ``k`` best of the vectors that a task holds for each of its queries, ties to the smaller id."""

    def run(batches):
        best, type_ = {}, None  # block of queries: their ids, and (place, id, score) found so far
        for b in batches:
            for one in (b.slice(i, 1) for i in range(b.num_rows)):
                type_ = one.schema.field("vs_ids").type.value_type
                (vid, vs), (qid, qs) = _read(one, "vs", kind), _read(one, "qs", kind)
                _, *held = best.get(n := one.column("qs_n")[0].as_py(), (qid, np.array([], int), vid[:0], np.array([])))
                best[n] = qid, *_found(vid, vs, qid, qs, held, k, step)
        for qid, place, ids, score in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(qid[place], type_), pa.array(ids, type_), pa.array(score, pa.float64(), mask=score == NONE)], ["query_id", "vec_id", "score"])

    return run


def _found(vid, vs, qid, qs, held, k, step):
    """(place, id, score) of the ``k`` best of each query among ``held`` and the block ``vs``."""
    least = _least(len(qid), held[0], held[2], k)
    found = [(np.array([], int), np.array([], int), np.array([]))]
    for n in sorted(qs.keys() & vs.keys()):
        (at, q), (to, v) = qs[n], vs[n]
        i, j, s = _met(q, v, qid[at], vid[to], least[at], k, step)
        found.append((at[i[s > NONE]], to[j[s > NONE]], s[s > NONE]))
    i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
    held = _best(*(np.concatenate(x) for x in zip(held, (i, vid[j], s), strict=True)), k)
    # Where fewer than k have a score, all of these are found, and the smallest ids of the others come next.
    for p in np.flatnonzero(_least(len(qid), held[0], held[2], k) <= NONE):
        free = vid != qid[p]
        free[j[i == p]] = False
        rest = vid[free][:k]
        held = tuple(np.concatenate(x) for x in zip(held, (np.full(len(rest), p), rest, np.full(len(rest), NONE)), strict=True))
    return _best(*held, k)
