"""Key sets that grow by rounds, and the records of each round."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import chance


def placed(rows: DataFrame, order: Column, *within: str) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in the order of a hash text within few groups, and the group's ``total``.

    Places come from counts by the hash's first three digits, so no task sees a whole group.
    """
    own = [F.col(c) for c in within] or [F.lit(1)]
    r = rows.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    sizes = r.groupBy(*within, "_b").agg(F.count("*").alias("_k"))  # 4096 rows of each group at most
    by = Window.partitionBy(*own)
    before = F.coalesce(F.sum("_k").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*within, "_b", before.alias("_before"), F.sum("_k").over(by).alias("total"))
    ties = [c for c in rows.columns if c not in within]
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_b").orderBy("_h", *ties))
    return r.join(sizes, [*within, "_b"]).withColumn("place", at).drop("_h", "_b", "_before")


def safe_start_share(ratios: Sequence[float]) -> float:
    """The largest share of all keys to begin with, so that they last through all rounds."""
    return max(0.0, min(1.0, prod(max(0.0, 1.0 - t) for t in ratios)))


def key_curriculum(structure: DataFrame, start: int, ratios: Sequence[float], seed: int) -> DataFrame:
    """(title, key, round): the round in which each key of structure(title, key) is first used, null if in none.

    Round 0 has ``start`` keys, by chance of the key.  In round i, new keys are to be the share ``ratios[i - 1]`` of all
    used so far: ceil(t / (1 - t) * before) are added, one at least while there are any; all of them at t = 1, none at 0.
    A key has one round in all its titles.
    """
    keys = placed(structure.select("key").filter("key is not null").distinct(), chance(seed, F.col("key")))
    none = F.array(F.least(F.lit(max(0, start)).cast("long"), F.col("total")))

    def grow(edges: Column, t: Column) -> Column:
        before = F.element_at(edges, -1)
        left = F.col("total") - before
        step = F.least(F.greatest(F.ceil(t / (1 - t) * before), F.lit(1).cast("long")), left)
        return F.concat(edges, F.array(before + F.when((left == 0) | (t <= 0), 0).when(t >= 1 - 1e-12, left).otherwise(step)))

    edges = F.aggregate(F.array(*[F.lit(float(t)) for t in ratios]), none, grow) if ratios else none
    keys = keys.withColumn("edges", edges)
    first = F.when(F.col("place") <= F.element_at("edges", -1), F.size(F.filter("edges", lambda e: e < F.col("place"))))
    return structure.select("title", "key").distinct().join(keys.select("key", first.alias("round")), "key").select("title", "key", "round")


def _chosen(records: DataFrame, keys: DataFrame, rounds: int, new_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(round, id, title, has_prev, has_new, picked) of records that hold a key of the round or of one before; and the fields they choose from."""
    named = records.filter(F.trim(F.coalesce("title", F.lit(""))) != "").select("id", "title", "key", "value")
    fields = named.join(keys.filter("round is not null").select("title", "key", "round"), ["title", "key"])
    filled = F.when(F.trim("value") != "", F.col("round"))
    per = fields.groupBy("id", "title").agg(F.min(filled).alias("first"), F.collect_set(filled).alias("own")).filter(f"first <= {rounds}")
    per = per.select("id", "title", "first", "own", F.explode(F.sequence("first", F.lit(rounds))).alias("round"))
    per = per.select("round", "id", "title", (F.col("first") < F.col("round")).alias("has_prev"), F.array_contains("own", F.col("round")).alias("has_new"))
    if new_share >= 1:
        return per.withColumn("picked", F.col("has_new")), fields
    new = placed(per.filter("has_new").select("round", "id", "title"), chance(seed, F.col("round"), F.col("id"), F.col("title")), "round")
    new = new.withColumn("picked", F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("total") * new_share))).drop("place", "total")
    return per.join(new, ["round", "id", "title"], "left").withColumn("picked", F.coalesce("picked", F.lit(False))), fields


def curriculum_records(records: DataFrame, keys: DataFrame, rounds: int, new_share: float = 1.0, least: int = 2, seed: int = 0) -> DataFrame:
    """(round, id, title, key, value): for each round up to ``rounds`` its records(id, title, key, value), with the keys used by then.

    Records that hold a key of an earlier round are taken, and the share ``new_share`` (one at least) of those that hold
    a new one, by chance; titles with fewer than ``least`` of them are dropped.  Records without a title, and keys
    without a round, take no part; null and empty values are left out, blank ones don't bring a record in.
    """
    per, fields = _chosen(records, keys, rounds, new_share, seed)
    taken = per.filter("has_prev or picked").select("round", "id", "title")
    large = taken.groupBy("round", "title").count().filter(F.col("count") >= least).select("round", "title")
    taken = taken.join(large, ["round", "title"], "left_semi").withColumnRenamed("round", "r")
    return fields.filter("value <> ''").join(taken, ["id", "title"]).filter("round <= r").select(F.col("r").alias("round"), "id", "title", "key", "value")


def curriculum_statistics(records: DataFrame, keys: DataFrame, rounds: int, new_share: float = 1.0, least: int = 2, seed: int = 0) -> DataFrame:
    """One row per round: candidates, records before and after small titles are dropped, titles kept and dropped, keys before and
    new, and the share of new keys."""
    per, _ = _chosen(records, keys, rounds, new_share, seed)
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    taken = F.col("has_prev") | F.col("picked")
    titles = per.groupBy("round", "title").agg(one(F.col("has_prev")).alias("p"), one(F.col("has_new")).alias("n"), one(F.col("picked")).alias("s"), one(taken).alias("t"))
    large = F.col("t") >= least
    rows = titles.groupBy("round").agg(
        F.sum("p").alias("prev_candidates"), F.sum("n").alias("new_candidates"), F.sum("s").alias("new_selected"), F.sum("t").alias("before_filter"),
        F.sum(F.when(large, F.col("t")).otherwise(0)).alias("after_filter"), one(large).alias("titles_kept"), one(~large & (F.col("t") > 0)).alias("titles_dropped"),
    )
    used = keys.filter("round is not null").groupBy("key").agg(F.min("round").alias("round")).groupBy("round").agg(F.count("*").alias("n"))
    at = keys.sparkSession.range(rounds + 1).select(F.col("id").cast("int").alias("r"))
    used = at.join(used, F.col("round") <= F.col("r"), "left").groupBy("r").agg(F.coalesce(F.sum(F.when(F.col("round") < F.col("r"), F.col("n"))), F.lit(0)).alias("keys_prev"), F.coalesce(F.sum(F.when(F.col("round") == F.col("r"), F.col("n"))), F.lit(0)).alias("keys_new"))
    total = F.col("keys_prev") + F.col("keys_new")
    used = used.withColumn("new_ratio", F.round(F.when(total > 0, F.col("keys_new") / total).otherwise(0.0), 6)).withColumnRenamed("r", "round")
    counts = [c for c in rows.columns if c != "round"]
    return used.join(rows, "round", "left").select("round", "keys_prev", "keys_new", "new_ratio", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
