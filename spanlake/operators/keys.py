"""Key dictionaries: structures (title, key, ord), aliases (title, key, alias, ord) and records (id, ord, title, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def canonical_records(records: DataFrame, aliases: DataFrame, separator: str = "；") -> DataFrame:
    """(id, title, key, value): keys replaced by their title's canonical key, else by the first of any title; distinct values joined in order."""
    local = aliases.groupBy("title", F.col("alias").alias("key")).agg(F.min_by(aliases["key"], F.struct("ord", aliases["key"])).alias("local"))
    everywhere = aliases.groupBy(F.col("alias").alias("key")).agg(F.min_by(aliases["key"], F.struct("ord", aliases["key"])).alias("global"))
    rows = records.join(local, ["title", "key"], "left").join(everywhere, "key", "left").withColumn("key", F.coalesce("local", "global", "key"))
    first = rows.groupBy("id", "title", "key", "value").agg(F.min("ord").alias("ord"))
    listed = first.groupBy("id", "title", "key").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("v"))
    return listed.select("id", "title", "key", F.array_join(F.transform("v", lambda x: x["value"]), separator).alias("value"))


def allowed(records: DataFrame, structure: DataFrame) -> DataFrame:
    """Records whose key its title has, by canonical form."""
    s = structure.select("title", T.canonical_key(F.col("key")).alias("std")).distinct()
    return records.withColumn("std", T.canonical_key(F.col("key"))).join(s, ["title", "std"], "left_semi").drop("std")


def missing_keys(records: DataFrame, structure: DataFrame) -> DataFrame:
    """(id, title, key) of keys that a record's title has and the record lacks."""
    own = records.groupBy("id", "title").agg(F.collect_set(F.struct("key")).alias("own"))
    of = structure.groupBy("title").agg(F.collect_set(F.struct("key")).alias("keys"))
    # Two lists meet in one row, so that no key is moved beside each record of its title.
    return own.join(of, "title").select("id", "title", F.explode(F.array_except("keys", "own")).alias("k")).select("id", "title", "k.key")


def replace_titles(base: DataFrame, other: DataFrame) -> DataFrame:
    """``base`` with whole titles replaced by those of ``other``, and new ones added."""
    return base.join(other.select("title").distinct(), "title", "left_anti").select(other.columns).unionByName(other)


def merge_aliases(sources: list[DataFrame]) -> DataFrame:
    """Aliases(title, key, alias, ord) of sources in order of priority: once by canonical form, not equal to the key, renumbered."""
    rows = None
    for rank, s in enumerate(sources):
        part = s.select("title", "key", "alias", "ord", F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("std", T.canonical_key(F.col("alias"))).filter(F.col("std") != T.canonical_key(F.col("key")))
    once = rows.groupBy("title", "key", "std").agg(F.min(F.struct("rank", "ord", "alias")).alias("x"))
    by = Window.partitionBy("title", "key").orderBy("x")
    return once.select("title", "key", F.col("x.alias").alias("alias"), F.row_number().over(by).alias("ord"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, key, old, new) where fields (id, key, value) differ, appear or go."""
    b, a = before.select("id", "key", F.col("value").alias("old")), after.select("id", "key", F.col("value").alias("new"))
    return b.join(a, ["id", "key"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def merged_back(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before(id, key, value)`` with the new values of ``after`` where there are any."""
    return before.join(after.select("id", "key", F.col("value").alias("new")), ["id", "key"], "left").select("id", "key", F.coalesce("new", "value").alias("value"))


def neighbours(records: DataFrame, structure: DataFrame, reach: int = 2, cap: int = 500) -> DataFrame:
    """(id, title, key, around): the values of keys within ``reach`` places of the key in its title's order."""
    by = Window.partitionBy("title").orderBy("ord", "key")
    place = structure.select("title", "key", F.row_number().over(by).alias("place"))
    rows = records.groupBy("id", "title", "key").agg(F.min_by("value", "ord").alias("value")).join(place, ["title", "key"])
    o = rows.select("id", "title", F.col("key").alias("k"), F.col("value").alias("v"), F.col("place").alias("p"))
    near = rows.join(o, ["id", "title"]).filter((F.abs(F.col("p") - F.col("place")) <= reach) & (F.col("p") != F.col("place")))
    listed = near.groupBy("id", "title", "key").agg(F.sort_array(F.collect_list(F.struct("p", "k", "v"))).alias("x"))
    return listed.select("id", "title", "key", F.left(F.array_join(F.transform("x", lambda t: F.concat(t["k"], F.lit("："), t["v"])), "；"), F.lit(cap)).alias("around"))


def by_structure(records: DataFrame, structure: DataFrame) -> DataFrame:
    """(id, keys): a record's keys in its title's order, unknown ones last in their own."""
    rows = records.groupBy("id", "title", "key").agg(F.min("ord").alias("own")).join(structure.select("title", "key", "ord"), ["title", "key"], "left")
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("ord", F.lit(1 << 40) + F.col("own")).alias("o"), "key"))).alias("x"))
    return listed.select("id", F.transform("x", lambda t: t["key"]).alias("keys"))


def matching_categories(docs: DataFrame, keywords: DataFrame, at_least: int = 1) -> DataFrame:
    """(category, doc_id, hits) of docs(doc_id, text) that hold ``at_least`` of the category's words of keywords(category, word)."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"))
    return words.join(keywords, "word").groupBy("category", "doc_id").agg(F.count_distinct("word").alias("hits")).filter(F.col("hits") >= at_least)
