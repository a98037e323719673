"""Exact top-k search by columnar branch and bound.

Vectors are laid out by dimension, in blocks of rows.  A block of queries meets a block of candidates: inner products
grow dimension block by dimension block, and after each, what the remaining dimensions can add at most (the product of
the remaining norms) decides which candidates can still reach the query's k best; the others are compacted away.  Each
query set is met in blocks, so neither side is ever held whole, and each task keeps k rows per query.

Components become ``floor(256 * x)``, and scores are integer inner products.  Vectors that are null, hold null or
non-finite components, or differ in length from the query take no part.  Ties go to the smaller id.  Rows with equal
ids are separate candidates, but never of their own id; query rows with equal ids each have a list of their own, ranks
1 to k.  Scaled components count as 2^53 at most, scores as 2^63 - 1, either way; scores beyond are ties.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize, prepare

SCALE, STEP = 256, 16
#: Scaled components beyond this count as this; scores beyond 64 bits count as their bound.
LARGEST, BOUND = 2.0**53, 2**63 - 1
QUERY_ROWS, CANDIDATE_ROWS = 512, 8192
BLOCK = "dims int, block long, ids binary, columns binary"


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of ``vectors(vec_id, embedding)`` of up to ``rows`` rows of one length, by dimension, as integers in float64."""

    def scan(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {}

        def emit(dims: int):
            nonlocal number
            ids, x = held.pop(dims)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(np.array(x).T).tobytes()], pa.binary())],
                ["dims", "block", "ids", "columns"],
            )

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if i is None or v is None or any(x is None for x in v) or not np.isfinite(x := np.array(v, np.float64)).all():
                    continue
                ids, xs = held.setdefault(len(v), ([], []))
                ids.append(i)
                with np.errstate(over="ignore"):
                    xs.append(np.clip(np.floor(SCALE * x), -LARGEST, LARGEST))
                if len(ids) == rows:
                    yield emit(len(v))
        for dims in list(held):
            yield emit(dims)

    return vectors.select("vec_id", "embedding").mapInArrow(scan, BLOCK).toDF("dims", *(f"{name}_{c}" for c in ("block", "ids", "columns")))


def meet(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (a column of ``q``) its k best of ``c`` with scores of at least ``floor``: (query, ids, scores)."""
    dims = len(q)
    exact = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) * max(1, dims) < 2**53
    if not exact:  # beyond float64, with Python's integers
        q, c = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape), np.array([[int(x) for x in r] for r in c], object).reshape(c.shape)
    edges = [*range(STEP, dims, STEP), dims]
    rest = lambda x, e: np.sqrt((x[e:].astype(np.float64) ** 2).sum(0))
    left = [(rest(q, e), rest(c, e)) for e in edges]
    first = q[: edges[0]].T @ c[: edges[0]] if dims else np.zeros((q.shape[1], c.shape[1]))
    for i in range(q.shape[1]):
        at, s, lo, low = np.flatnonzero(c_ids != q_ids[i]), None, edges[0] if dims else 0, floor[i]
        s = first[i][at]
        for e, (rq, rc) in zip(edges, left, strict=True):
            if e > lo:
                s = s + q[lo:e, i] @ c[lo:e][:, at]
                lo = e
            slack = rq[i] * rc[at] * (1 + 1e-9)
            worst = (s - slack).astype(np.float64)
            if len(at) > k:  # k candidates surely reach this
                low = min(max(low, np.partition(worst, len(at) - k)[len(at) - k]), float(BOUND))
            alive = (s + slack).astype(np.float64) >= low - 1e-6 * max(1.0, abs(low))
            at, s = at[alive], s[alive]
        s = np.array([max(-BOUND, min(BOUND, int(x))) for x in s], np.int64) if not exact else s.astype(np.int64)
        order = np.lexsort((c_ids[at], -s))[:k]
        yield i, c_ids[at[order]], s[order]


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The ``k`` best (query_id, rank, vec_id, score) of each query among all other rows of ``vectors(vec_id, embedding)``."""
    prepare(vectors.sparkSession)
    q = materialize(blocks(vectors.filter(is_query), QUERY_ROWS, "q"))
    c = materialize(blocks(vectors, CANDIDATE_ROWS, "c"))
    # The stated query set against all rows: only blocks meet here, of a few hundred and a few thousand rows.
    pairs = q.crossJoin(c.withColumnRenamed("dims", "c_dims"))

    def scan(batches):
        best: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}  # query block: query: ids, scores
        names: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["dims"] != r["c_dims"]:
                    continue
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                qx, cx = (np.frombuffer(r[f"{n}_columns"]).reshape(r["dims"], -1) if r["dims"] else np.zeros((0, len(i))) for n, i in (("q", qi), ("c", ci)))
                own, names[r["q_block"]] = best.setdefault(r["q_block"], {}), qi
                floor = np.array([float(own[i][1][k - 1]) if i in own and len(own[i][1]) == k else -np.inf for i in range(len(qi))])
                for i, ids, s in meet(qx, cx, qi, ci, k, floor):
                    if i in own:
                        ids, s = np.r_[own[i][0], ids], np.r_[own[i][1], s]
                    order = np.lexsort((ids, -s))[:k]
                    own[i] = ids[order], s[order]
        for block, own in best.items():
            rows = [(block, i, int(names[block][i]), int(v), int(s)) for i, (ids, scores) in own.items() for v, s in zip(ids, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], ["block", "place", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(scan, "block long, place long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
