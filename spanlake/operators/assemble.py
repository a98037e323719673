"""Keys and values put together from spans (doc, start, end, type, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOSPITAL = "医院"
STUB = "无键名"


def latest(annotations: DataFrame, rule: str = "newest") -> DataFrame:
    """One of ``annotations(task, pos, cancelled, updated_at, created_at, ...)`` per task.

    ``newest``: the latest times among those not cancelled, else among all; ties go to the later position.
    ``last``: the last one not cancelled, if any.
    """
    if rule == "last":
        rows, order = annotations.filter(~F.col("cancelled")), [F.desc("pos")]
    elif rule == "newest":
        rows, order = annotations, [F.col("cancelled").asc(), F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc("pos")]
    else:
        raise ValueError("rule is newest or last")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("task").orderBy(*order))).filter("rn = 1").drop("rn")


def by_relation(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc, key, value, start, end) from ``entities(doc, id, type, start, end, text)`` and ``relations(doc, from_id, to_id, ord)``.

    The last relation of a key counts; a key without one is empty at its end; one whose target is no VALUE is dropped; of
    equal keys the last value stays.
    """
    keys = entities.filter("type = 'KEY'").select("doc", F.col("id").alias("from_id"), F.col("text").alias("key"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    last = relations.groupBy("doc", "from_id").agg(F.max_by("to_id", "ord").alias("to_id"))
    values = entities.select("doc", F.col("id").alias("to_id"), "type", F.col("text").alias("value"), "start", "end")
    rows = keys.join(last, ["doc", "from_id"], "left").join(values, ["doc", "to_id"], "left").filter("to_id is null or type = 'VALUE'")
    one = F.struct(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("start", "k_end").alias("start"), F.coalesce("end", "k_end").alias("end"))
    return rows.groupBy("doc", "key").agg(F.max_by(one, "k_start").alias("x")).select("doc", "key", "x.*")


def by_place(spans: DataFrame) -> DataFrame:
    """(doc, key, start, end, values): each VALUE belongs to the KEY last before it; the span covers all its values.

    A key without value is empty at its own end.  Values before any key stand under numbered stubs; headers (HOSPITAL)
    under a key of their own, the first one.
    """
    by = Window.partitionBy("doc").orderBy("start", "end")
    key = F.struct(F.col("text").alias("key"), F.col("end").alias("at"), F.col("start").alias("k"))
    body = spans.filter("type in ('KEY', 'VALUE')").withColumn("own", F.last(F.when(F.col("type") == "KEY", key), True).over(by))
    value = F.col("type") == "VALUE"
    named = body.filter("own is not null").groupBy("doc", "own").agg(F.min(F.when(value, F.col("start"))).alias("start"), F.max(F.when(value, F.col("end"))).alias("end"), F.sum(value.cast("long")).alias("values"))
    named = named.select("doc", F.col("own.key").alias("key"), F.coalesce("start", "own.at").alias("start"), F.coalesce("end", "own.at").alias("end"), "values")
    orphans = body.filter("own is null").withColumn("n", F.row_number().over(by)).select("doc", F.concat(F.lit(STUB), F.col("n").cast("string")).alias("key"), "start", "end", F.lit(1).cast("long").alias("values"))
    head = spans.filter("type = 'HOSPITAL'").groupBy("doc").agg(F.min(F.struct("start", "end")).alias("x")).select("doc", F.lit(HOSPITAL).alias("key"), "x.start", "x.end", F.lit(1).cast("long").alias("values"))
    return named.unionByName(orphans).unionByName(head)


def joined_values(spans: DataFrame, separator: str = "；") -> DataFrame:
    """(doc, key, value): the values of each key in order, joined; values without key under the empty key."""
    by = Window.partitionBy("doc").orderBy("start", "end")
    body = spans.filter("type in ('KEY', 'VALUE')").withColumn("key", F.coalesce(F.last(F.when(F.col("type") == "KEY", F.col("text")), True).over(by), F.lit("")))
    listed = body.groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.when(F.col("type") == "VALUE", F.struct("start", "end", "text")))).alias("v"))
    return listed.select("doc", "key", F.array_join(F.transform("v", lambda x: x["text"]), separator).alias("value"))


def longest_by_label(spans: DataFrame) -> DataFrame:
    """(doc, type, text): the longest text of each type; of equally long ones the later."""
    return spans.groupBy("doc", "type").agg(F.max_by("text", F.struct(F.length("text"), "start")).alias("text"))


def locate_pairs(records: DataFrame, aliases: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, key, form, key_start, value_start) of records(id, key, value) all of whose pairs are in ``texts(id, body)``.

    A key is sought as itself and its aliases(key, alias); forms with a separator come first, then longer ones.
    """
    names = records.join(aliases, "key", "left").select("id", "key", "value", F.explode(F.array_distinct(F.filter(F.array("key", "alias"), lambda x: x.isNotNull()))).alias("name"))
    forms = names.select("*", F.posexplode(F.array(F.concat("name", F.lit("：")), F.concat("name", F.lit(":")), "name")).alias("sep", "form"))
    found = forms.join(texts, "id").withColumn("k", F.expr("instr(body, form)")).filter("k > 0")
    order = F.struct(F.when(F.col("sep") < 2, 0).otherwise(1), -F.length("name"), F.col("sep"), F.col("name"))
    best = found.groupBy("id", "key", "value").agg(F.min_by(F.struct("form", "k", "body"), order).alias("x")).select("id", "key", "value", "x.*")
    best = best.withColumn("v", F.expr("instr(substring(body, k + length(form)), value)")).filter("v > 0 and value <> ''")
    wanted, got = records.groupBy("id").agg(F.count("*").alias("wanted")), best.groupBy("id").agg(F.count("*").alias("got"))
    whole = wanted.join(got, "id").filter("wanted = got").select("id")
    return best.join(whole, "id", "left_semi").select("id", "key", "form", (F.col("k") - 1).alias("key_start"), (F.col("k") + F.length("form") + F.col("v") - 2).alias("value_start"))


def clean_aliases(entries: Column) -> Column:
    """A map of name to alias without blank names or aliases, both trimmed."""
    trimmed = F.transform(F.map_entries(entries), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    return F.map_from_entries(F.filter(trimmed, lambda e: (e["key"] != "") & (e["value"] != "")))
