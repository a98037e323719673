"""URL rules by a cascade of Bloom filters.

The listed keys (host and path of each rule) go into a first filter; the keys of the corpus that it wrongly lets pass
go into a second; the listed keys that the second holds go into a third, and so on until no key is wrong.  The key
universe is complete: every key that any url of the table could match.  So membership is exact, without a join: a key
is listed if the first level that denies it is an even one (counting from 1).

A rule fits its host and all subdomains, if the url's path starts with the rule's path; the longest host wins, then
the longest path.  Filters are broadcast; beyond ``MAX_BITS`` (32 MB) keys are looked up by a join instead.

Null urls and urls without ``://`` have an empty host and path, which no rule fits.  A url that no rule fits gets the
``default`` verdict: it isn't on any list.  Of a host of many labels only as many as the longest rule has are looked at.
Repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import materialize, prepare

MAX_BITS, BITS_PER_KEY, HASHES = 1 << 28, 12, 6
ALLOW, BLOCK = "allow", "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, upper, lower), F.regexp_extract(after, r"^[^?#]*", 0)


def candidate_keys(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """Keys a url could match, longest first: each suffix of its host of up to ``most`` labels, which no rule's host exceeds,
    with its path's starts of the rules' lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(0), F.size(labels) - most), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    starts = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)))
    starts = F.filter(starts, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    return F.when(host == "", F.expr("cast(array() as array<string>)")).otherwise(keys)


def _bits_of(key: Column, level: int, bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.pmod(F.xxhash64(key, F.lit(level), i), F.lit(bits)))


def _fill(keys: DataFrame, level: int, n: int) -> tuple[int, np.ndarray]:
    """A filter of the ``n`` keys: each bit is set where the keys are, words of 64 bits are put together by key."""
    bits = min(MAX_BITS, max(64, 1 << (n * BITS_PER_KEY - 1).bit_length()))
    at = keys.select(F.explode(_bits_of(F.col("key"), level, bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return bits, out


def build(listed: DataFrame, universe: DataFrame, spark: SparkSession) -> list[tuple[int, np.ndarray]] | None:
    """The levels for ``listed(key)`` over ``universe(key)``; None if a filter would be too large."""
    levels: list[tuple[int, np.ndarray]] = []
    inside, outside = materialize(listed.select("key").distinct()), universe.join(listed, "key", "left_anti")
    own, other = inside, outside
    while n := own.count():
        if n * BITS_PER_KEY > MAX_BITS:
            return None
        levels.append(_fill(own, len(levels), n))
        own, other = materialize(_passing(other, levels[-1], len(levels) - 1).distinct()), own
    return levels


def _passing(keys: DataFrame, level: tuple[int, np.ndarray], number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def scan(batches):
        bits, words = shared.value
        for b in batches:
            at = b.column("at").combine_chunks() if isinstance(b.column("at"), pa.ChunkedArray) else b.column("at")
            at = at.flatten().to_numpy().reshape(-1, HASHES)
            ok = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1) if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(ok))], ["key"])

    return keys.select("key", _bits_of(F.col("key"), number, level[0]).alias("at")).mapInArrow(scan, "key string")


def with_members(frame: DataFrame, levels: list[tuple[int, np.ndarray]], name: str) -> DataFrame:
    """``frame`` with the first listed one of its ``keys``, which are of the universe, as column ``name``."""
    shared = frame.sparkSession.sparkContext.broadcast([w for _, w in levels])

    def bits_at(level: int) -> Column:
        return F.flatten(F.transform("keys", lambda k: _bits_of(k, level, levels[level][0])))

    def scan(batches):
        for b in batches:
            keys = b.column("keys")
            sizes = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, row = keys.flatten(), np.repeat(np.arange(b.num_rows), sizes)
            listed, open_ = np.zeros(len(flat), bool), np.ones(len(flat), bool)
            for n, words in enumerate(shared.value):
                at = b.column(f"at_{n}").flatten().to_numpy().reshape(-1, HASHES)
                held = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)
                listed[open_ & ~held] = n % 2 == 1  # the first level to deny it
                open_ &= held
            listed[open_] = len(shared.value) % 2 == 1
            rows, first = np.unique(row[listed], return_index=True)
            place = np.full(b.num_rows, -1)
            place[rows] = np.flatnonzero(listed)[first]
            found = flat.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], found], [*names, name])

    import pyarrow.compute  # noqa: F401

    names = frame.columns
    schema = StructType(list(frame.schema.fields)).add(name, "string")
    return frame.select(*names, *(bits_at(i).alias(f"at_{i}") for i in range(len(levels)))).mapInArrow(scan, schema)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) for ``pages(page_id, url)`` by ``rules`` (verdict, host, path)."""
    spark = pages.sparkSession
    prepare(spark)
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), sorted({len(p) for *_, p in rules}), max([1, *(h.count(".") + 1 for _, h, _ in rules)])))
    keyed = materialize(keyed)
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    frame = keyed
    for kind in (ALLOW, BLOCK):
        own = sorted({h + p for v, h, p in rules if v == kind})
        listed = spark.createDataFrame([(k,) for k in own], "key string")
        levels = build(listed, universe, spark)
        if levels is None:  # too many keys to broadcast a filter of
            hits = frame.select(F.explode("keys").alias("key")).distinct().join(listed, "key", "left_semi")
            hits = frame.select("keys", F.posexplode("keys").alias("place", "key")).join(hits, "key").groupBy("keys").agg(F.min_by("key", "place").alias(kind))
            frame = frame.join(hits, "keys", "left")
        else:
            frame = with_members(frame, levels, kind)
    place = {k: F.when(F.col(k).isNotNull(), F.array_position("keys", F.col(k))) for k in (ALLOW, BLOCK)}  # keys are longest first
    allowed = F.col(ALLOW).isNotNull() & (F.col(BLOCK).isNull() | (place[ALLOW] <= place[BLOCK]))
    verdict = F.when(allowed, F.lit(ALLOW)).when(F.col(BLOCK).isNotNull(), F.lit(BLOCK)).otherwise(F.lit(default))
    return frame.select("page_id", "host", "path", F.when(allowed, F.col(ALLOW)).otherwise(F.col(BLOCK)).alias("rule"), verdict.alias("verdict"))
