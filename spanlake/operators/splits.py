"""Splits of annotated rows by chance of their ids, with exact sizes; and what a dataset is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curate import chance
from .curriculum import placed
from ..functions import text as T


def _by_place(rows: DataFrame, id_: str, seed: int, split) -> DataFrame:
    """``rows`` with ``split(place, total)``, places from 1 in the order of chance."""
    out = placed(rows, chance(seed, F.col(id_)))
    return out.withColumn("split", split(F.col("place"), F.col("total"))).drop("place", "total")


def eval_split(rows: DataFrame, id_: str, share: float, seed: int) -> DataFrame:
    """``split``: eval for floor(n * share) rows, one at least, train for the others."""
    return _by_place(rows, id_, seed, lambda i, n: F.when(i > n - F.greatest(F.lit(1), F.floor(n * share)), "eval").otherwise("train"))


def pool_split(rows: DataFrame, id_: str, test_share: float, seed: int) -> DataFrame:
    """A pool of validation rows as ``split`` val and test: ceil(n * test_share) of these."""
    return _by_place(rows, id_, seed, lambda i, n: F.when(i <= F.ceil(n * test_share), "test").otherwise("val"))


def three_way(rows: DataFrame, id_: str, train: float, val: float, seed: int, labelled: Column | None = None) -> DataFrame:
    """``rows`` (those that are ``labelled``) with ``split`` train, val or test, and ``copy``, 0 for the original.

    floor(n * train) rows train; of the others floor(m * val / (1 - train)) are val, the rest test; without ``val`` all of
    them are test.  Of one or two rows there are copies, so that there are three in all.
    """
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError("shares: train above 0, val not below 0, together below 1")
    some = placed(rows if labelled is None else rows.filter(labelled), chance(seed, F.col(id_)))
    # One row stands three times; of two, the first stands twice.
    copies = F.when(F.col("total") == 1, 3).when((F.col("total") == 2) & (F.col("place") == 1), 2).otherwise(1)
    some = some.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    n = F.greatest(F.col("total"), F.lit(3))
    place = F.when(F.col("total") < 3, F.col("place") + F.when(F.col("copy") > 0, F.col("copy") + F.col("total") - F.col("place")).otherwise(0)).otherwise(F.col("place"))
    first = F.floor(n * train)
    second = F.floor((n - first) * (val / (1 - train)))
    return some.withColumn("split", F.when(place <= first, "train").when(place <= first + second, "val").otherwise("test")).drop("place", "total")


#: Separators between items.
ITEM_SEPARATORS = (" ", "。", "；", "，")


def item_separators(rows: DataFrame, group: str, order: str, seed: int) -> DataFrame:
    """``rows`` with ``separator``: the least used of four so far in the ``group``, by chance among those used equally.

    So each run of four items has all four, in an order of its own.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    turns = F.array_sort(F.array(*[F.struct(chance(seed, F.col(group), F.floor(F.col("_n") / 4), F.lit(i)).alias("h"), F.lit(s).alias("s")) for i, s in enumerate(ITEM_SEPARATORS)]))
    return rows.withColumn("_n", n).withColumn("separator", F.get(turns, (F.col("_n") % 4).cast("int"))["s"]).drop("_n")


def dataset_stats(records: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: samples, input_tokens (of reports(id, title, report)), output_tokens (of the values of records(id, key, value)),
    unique_keys, unique_titles, keys_per_sample."""
    r = reports.agg(F.count("*").alias("samples"), F.sum(T.token_count(F.coalesce("report", F.lit("")))).alias("input_tokens"), F.count_distinct(F.when(F.col("title") != "", F.col("title"))).alias("unique_titles"))
    k = records.agg(F.sum(T.token_count(F.coalesce("value", F.lit("")))).alias("output_tokens"), F.count_distinct("key").alias("unique_keys"), F.count("*").alias("keys"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = F.round(F.col("keys") / F.greatest(F.lit(1), F.col("samples")), 3)
    return r.crossJoin(k).select("samples", zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"), "unique_keys", "unique_titles", per.alias("keys_per_sample"))


#: When values are too few for the keys, rows too few in all, and too many of them cut.
VALUES_TO_KEYS, ENOUGH_ROWS, CUT_SHARE = 0.8, 1000, 0.3


def diagnosis(texts: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """One row: rows, least, most, mean and upper median of the tokens of texts(doc, text), the share above ``limit``, the
    counts of types of entities(doc, type), and ``issues``: few_values, few_rows, many_cut.

    The median is read off the counts of lengths, so no task sorts all rows.
    """
    lengths = texts.select(T.token_count(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    listed = lengths.agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("x"), F.sum("k").alias("rows"), F.sum(F.col("n") * F.col("k")).alias("total"), F.sum(F.when(F.col("n") > limit, F.col("k")).otherwise(0)).alias("cut"))
    at = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("n")), lambda a, x: F.struct((a["upto"] + x["k"]).alias("upto"), F.when(a["n"].isNull() & (a["upto"] + x["k"] > F.floor(F.col("rows") / 2)), x["n"]).otherwise(a["n"]).alias("n")), lambda a: a["n"])
    types = entities.groupBy("type").agg(F.count("*").alias("k")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "k")))).alias("types"))
    rows = listed.crossJoin(types)
    share = F.col("cut") / F.greatest(F.lit(1), F.col("rows"))
    of = lambda name: F.coalesce(F.try_element_at("types", F.lit(name)), F.lit(0))
    flag = lambda test, name: F.when(test, F.lit(name))
    issues = F.array_compact(F.array(flag(of("VALUE") < of("KEY") * VALUES_TO_KEYS, "few_values"), flag(F.coalesce("rows", F.lit(0)) < ENOUGH_ROWS, "few_rows"), flag(share > CUT_SHARE, "many_cut")))
    first = F.get("x", F.lit(0))["n"]
    return rows.select(F.coalesce("rows", F.lit(0)).alias("rows"), first.alias("least"), F.try_element_at("x", F.lit(-1))["n"].alias("most"), F.round(F.col("total") / F.col("rows"), 1).alias("mean"), at.alias("median"), F.round(share, 6).alias("cut_share"), "types", issues.alias("issues"))


def value_lists(spans: DataFrame) -> DataFrame:
    """(doc, key, values) of KEY and VALUE spans(doc, type, text, start, end): a key's values in order, over all its places.

    Values belong to the last key before them; a key without any has an empty list; values before any key have a null key.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("doc").orderBy("start", "end")
    rows = spans.filter(F.col("type").isin("KEY", "VALUE")).select("doc", "type", "text", "start", "end").withColumn("key", F.last(F.when(F.col("type") == "KEY", F.col("text")), True).over(by))
    v = F.sort_array(F.collect_list(F.when(F.col("type") == "VALUE", F.struct("start", "text"))))
    return rows.groupBy("doc", "key").agg(F.transform(v, lambda x: x["text"]).alias("values"))
