"""Alias maps brought to canonical keys by a decision table, and filled, with a log of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _name(c) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(T.SPACES))


def remapped_aliases(aliases: DataFrame, structure: DataFrame, decisions: DataFrame) -> DataFrame:
    """aliases(id, title, key, alias, ord) with ``task``, ``canon``, ``confidence``, ``reason`` and ``taken``.

    A key of the title's structure(title, key) is ``kept``.  Another is looked up in decisions(title, data_key, mapped,
    confidence, reason) by its alias, or by itself if that is blank: ``alias_key_remap`` if this leads to a key of the title,
    else ``alias_key_remap_failed``.  Of several that lead to one canonical key of a record the first is ``taken``.
    """
    known = structure.select(F.col("title").alias("s_title"), _name("key").alias("s_name"), F.col("key").alias("s_key")).filter("s_name <> ''").dropDuplicates(["s_title", "s_name"])
    rows = aliases.select("id", "title", "key", "alias", "ord", _name("key").alias("name"), F.when(_name("alias") != "", _name("alias")).otherwise(_name("key")).alias("data_key"))
    rows = rows.join(known.toDF("k_title", "k_name", "own"), (F.col("title") == F.col("k_title")) & (F.col("name") == F.col("k_name")), "left").drop("k_title", "k_name")
    said = decisions.select(F.col("title").alias("d_title"), F.col("data_key").alias("d_key"), _name("mapped").alias("mapped"), "confidence", "reason").dropDuplicates(["d_title", "d_key"])
    rows = rows.join(said, (F.col("title") == F.col("d_title")) & (F.col("data_key") == F.col("d_key")) & F.col("own").isNull(), "left").drop("d_title", "d_key")
    rows = rows.join(known.toDF("k_title", "k_name", "other"), (F.col("title") == F.col("k_title")) & (F.col("mapped") == F.col("k_name")), "left").drop("k_title", "k_name")
    rows = rows.withColumn("canon", F.coalesce("own", "other"))
    task = F.when(F.col("own").isNotNull(), "kept").when(F.col("other").isNotNull(), "alias_key_remap").otherwise("alias_key_remap_failed")
    rows = rows.withColumn("task", task)
    first = rows.filter("canon is not null").groupBy("id", "title", "canon").agg(F.min(F.struct("ord", "key")).alias("first"))
    rows = rows.join(first, ["id", "title", "canon"], "left").withColumn("taken", F.coalesce((F.col("first.ord") == F.col("ord")) & (F.col("first.key") == F.col("key")), F.lit(False)))
    shown = F.col("task") == "alias_key_remap"
    return rows.select("id", "title", "key", "alias", "ord", "task", "canon", F.when(shown, F.col("confidence")).alias("confidence"), F.when(shown, F.col("reason")).alias("reason"), "taken")


def filled_aliases(aliases: DataFrame, structure: DataFrame, records: DataFrame, reports: DataFrame, mappings: DataFrame, found: DataFrame) -> DataFrame:
    """(id, title, key, alias, task, value, found, context): the alias of each canonical key of each record's title.

    From aliases(id, title, key, alias) (the taken rows of ``remapped_aliases``), records(id, title, key, value),
    reports(id, report), mappings(title, data_key, mapped) of fields to canonical keys, and found(key, value, alias), what a
    look-up of a value in its report has given.  A key that no field of the record leads to is empty, as is one without a
    value.  One that a field leads to, and that has an alias, keeps it (no ``task``).  Else the alias found for the key and
    its value is cleaned and taken: ``fill_from_mapping`` where a mapped field led there, ``fill_missing`` otherwise.
    ``context`` is what stands around the value in the report, 240 characters at most.
    """
    names = structure.select("title", "key").filter(_name("key") != "").distinct()
    ids = records.select("id", "title").distinct()
    own = records.groupBy("id", "title", "key").agg(F.max(F.when(_name("value") != "", F.col("value"))).alias("value"))
    led = own.join(mappings.select("title", F.col("data_key").alias("key"), F.col("mapped").alias("to")).distinct(), ["title", "key"]).groupBy("id", "title", F.col("to").alias("key")).agg(F.min(F.struct("key", "value")).alias("by"))
    rows = ids.join(names, "title").join(own.withColumn("mentioned", F.lit(True)), ["id", "title", "key"], "left").join(led, ["id", "title", "key"], "left")
    rows = rows.join(aliases.select("id", "title", "key", F.col("alias").alias("old")), ["id", "title", "key"], "left")
    mapped, has = F.col("by").isNotNull(), ~T.is_missing(F.col("old"))
    rows = rows.withColumn("value", F.btrim(F.coalesce("value", "by.value"), F.lit(T.SPACES))).withColumn("there", F.col("mentioned").isNotNull() | mapped)
    looked = F.col("there") & ~has & F.col("value").isNotNull()
    rows = rows.join(found.select(F.col("key").alias("f_key"), F.btrim("value", F.lit(T.SPACES)).alias("f_value"), F.col("alias").alias("new")).dropDuplicates(["f_key", "f_value"]), (F.col("key") == F.col("f_key")) & (F.col("value") == F.col("f_value")) & looked, "left")
    rows = rows.join(reports.select("id", "report"), "id", "left")
    clean = T.clean_alias(F.col("key"), F.col("new"), F.col("value"))
    alias = F.when(F.col("there") & has, F.col("old")).when(looked & F.col("new").isNotNull(), clean).otherwise("")
    task = F.when(F.col("there") & has, None).when(mapped & looked, "fill_from_mapping").otherwise("fill_missing")
    text = F.when(F.col("value").isNotNull() & task.isNotNull() & F.col("report").isNotNull(), F.left(T.context(F.col("report"), F.col("value")), F.lit(240)))
    return rows.select("id", "title", "key", alias.alias("alias"), task.alias("task"), "value", (looked & F.col("new").isNotNull()).alias("found"), F.coalesce(text, F.lit("")).alias("context"))


def lexicon_similarity(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with ``score``: 0 if one is empty, else the lexicon's score of the pair, either way round, else the
    Jaccard index of their characters.

    lexicon(a, b, score) may hold a pair both ways: then its own order counts; of repeated rows, the highest score.  Each
    pair is looked up once, by its two texts in order; the planner broadcasts a small lexicon by its measured size.
    """
    from .curate import similarity

    low, high = F.least("a", "b"), F.greatest("a", "b")
    way = F.col("a") == F.col("low")
    known = lexicon.select(low.alias("low"), high.alias("high"), "a", "b", "score").filter("a is not null and b is not null")
    known = known.groupBy("low", "high").agg(F.max(F.when(way, F.col("score"))).alias("there"), F.max(F.when(~way, F.col("score"))).alias("back"))
    rows = pairs.withColumns({"_low": low, "_high": high}).join(known, (F.col("_low") == F.col("low")) & (F.col("_high") == F.col("high")), "left")
    said = F.when(F.col("a") == F.col("_low"), F.coalesce("there", "back")).otherwise(F.coalesce("back", "there"))
    a, b = (F.coalesce(c, F.lit("")) for c in ("a", "b"))
    score = F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.coalesce(said, similarity(a, b)))
    return rows.select(*pairs.columns, score.alias("score"))
