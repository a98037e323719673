"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_sql(items: str, size: str, budget: int) -> str:
    """SQL of a list of (n, x): neighbours of the list ``items`` while the sum of ``size`` (of ``i``) stays within ``budget``."""
    return f"""list_reduce(list_transform({items}, lambda i: [{{'n': ({size})::BIGINT, 'x': [i]}}]),
        lambda a, b: CASE WHEN a[-1].n + b[1].n <= {budget} THEN list_append(a[:-2], {{'n': a[-1].n + b[1].n, 'x': list_concat(a[-1].x, b[1].x)}}) ELSE list_concat(a, b) END)"""
