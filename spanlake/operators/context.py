"""The context that a scorer is given with a field: its query, its neighbours, and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curate import shown_examples
from .keys import canonical_records, neighbours


def field_queries(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, title, key, query) of records(id, title, key): the title, the key, and the aliases of what the key stands for.

    A key that is an alias stands for the first key with that alias (by ord, then name), of any title; one that is none
    for nothing.  The aliases of a key, over all titles, come in order, each once.
    """
    canon = aliases.groupBy(F.col("alias").alias("key")).agg(F.min_by(aliases["key"], F.struct("ord", aliases["key"])).alias("canon"))
    first = aliases.groupBy("key", "alias").agg(F.min("ord").alias("ord"))
    names = first.groupBy(F.col("key").alias("canon")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]), " ").alias("names"))
    rows = records.select("id", "title", "key").distinct().join(canon, "key", "left").join(names, "canon", "left")
    return rows.select("id", "title", "key", F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), "key", "names").alias("query"))


def scorer_contexts(records: DataFrame, structure: DataFrame, aliases: DataFrame, hits: DataFrame, k: int = 3, reach: int = 2, limit: int = 500, shown: int = 500) -> DataFrame:
    """(id, title, key, query, around, examples) of each field of records(id, ord, title, key, value).

    ``query`` is that of ``field_queries``; ``around`` the values of keys within ``reach`` places in the structure(title, key,
    ord), after records' keys have been made canonical (empty if there are none); ``examples`` the ``k`` best of
    hits(id, rank, text) of the record, shortened to ``shown`` characters.
    """
    # Canonical records have one value for each key, so any order of them will do.
    near = neighbours(canonical_records(records, aliases).withColumn("ord", F.lit(0)), structure, reach, limit)
    best = hits.filter(F.col("rank") <= k).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    rows = field_queries(records, aliases).join(near, ["id", "title", "key"], "left").join(best, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", "title", "key", "query", F.coalesce("around", F.lit("")).alias("around"), F.coalesce(shown_examples(F.col("texts"), shown), none).alias("examples"))
