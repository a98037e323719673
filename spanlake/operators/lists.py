"""Rows of several frames that meet as lists, one row for each document: no pair of them becomes a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_doc(key: str = "doc", **frames: DataFrame) -> DataFrame:
    """(key, name...): the rows of each of ``frames`` as a list of structs without the key, empty where a frame lacks it.

    All frames are dealt by the key at once, so there is one shuffle and no join; lists are in no order.  A null key is a key.
    """
    rows = None
    for name, frame in frames.items():
        one = frame.select(key, F.struct(*[F.col(c) for c in frame.columns if c != key]).alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.repartition(key).groupBy(key).agg(*[F.collect_list(name).alias(name) for name in frames])
