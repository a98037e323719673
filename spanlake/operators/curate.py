"""Balancing, splitting, sampling and deduplicating rows; random choices are hashes of ids, so any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import bound_batches
from ..sources.sinks import staged
from .cosine import best_of, packed
from .fold import pack


def chance(*parts) -> Column:
    """The order that stands for a shuffle: md5 of the parts."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def bucket(*parts) -> Column:
    """The first 8 hex digits of the md5, modulo 10000."""
    return F.conv(F.substring(F.md5(F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))), 1, 8), 16, 10).cast("long") % 10000


def cap_per_title(rows: DataFrame, title: str, order: list, most: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(title).orderBy(*order))).filter((F.col("rn") <= most) | (F.coalesce(title, F.lit("")) == "")).drop("rn")


def title_counts(rows: DataFrame, title: str) -> DataFrame:
    return rows.groupBy(title).agg(F.count("*").alias("n"))


def upper_median(counts: DataFrame) -> DataFrame:
    """The element n // 2 (from 0) of the sorted counts, of a small table with one row for each title."""
    return counts.agg(F.sort_array(F.collect_list("n")).alias("v")).select(F.expr("v[cast(floor(size(v) / 2) as int)]").alias("target"))


def mean_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.bround(F.avg("n")).cast("long").alias("target"))


def downsample(rows: DataFrame, title: str, id_: str, seed: int) -> DataFrame:
    """At most the mean count of rows for each title, by chance."""
    target = mean_count(title_counts(rows, title))
    by = Window.partitionBy(title).orderBy(chance(seed, F.col(id_)), id_)
    return rows.withColumn("rn", F.row_number().over(by)).crossJoin(F.broadcast(target)).filter("rn <= target").drop("rn", "target")


def upsample(rows: DataFrame, title: str, id_: str) -> DataFrame:
    """Titles below the median are filled up with copies in turn; ``copy`` is 0 for the original."""
    counts = title_counts(rows, title)
    by = Window.partitionBy(title).orderBy(chance(0, F.col(id_)), id_)
    ranked = rows.join(counts.crossJoin(upper_median(counts)), title).withColumn("rn", F.row_number().over(by) - 1)
    copies = F.when(F.col("n") >= F.col("target"), F.lit(1)).otherwise(F.floor((F.col("target") - 1 - F.col("rn")) / F.col("n")) + 1)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))).drop("rn", "n", "target")


def quotas(rows: DataFrame, title: str, id_: str, target: int) -> DataFrame:
    """(title, id, quota): what titles below ``target`` lack, dealt evenly; the remainder goes to the first by chance."""
    counts = title_counts(rows, title).filter(F.col("n") < target)
    by = Window.partitionBy(title).orderBy(chance(1, F.col(id_)), id_)
    r = rows.join(counts, title).withColumn("rn", F.row_number().over(by))
    need = F.lit(target) - F.col("n")
    return r.select(title, id_, (F.floor(need / F.col("n")) + (F.col("rn") <= need % F.col("n")).cast("long")).alias("quota"))


def ratio_split(rows: DataFrame, id_: str, ratios: list[tuple[str, float]], seed: int) -> DataFrame:
    """``split`` by place in the shuffled order: exact sizes, floor(n * share) each, the rest in the last.

    Places come from counts per hash bucket, so no task sees all rows.
    """
    r = rows.withColumn("h", chance(seed, F.col(id_))).withColumn("b", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    sizes = r.groupBy("b").agg(F.count("*").alias("k"))  # 256 rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(1))))
    placed = r.join(F.broadcast(before.drop("k")), "b").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", id_)))
    out, edge = None, F.lit(0).cast("long")
    for name, share in ratios[:-1]:
        edge = edge + F.floor(F.col("total") * share)
        out = F.when(F.col("place") <= edge, name) if out is None else out.when(F.col("place") <= edge, name)
    last = F.lit(ratios[-1][0])
    return placed.withColumn("split", last if out is None else out.otherwise(last)).drop("h", "b", "before", "total", "place")


def stratified_split(rows: DataFrame, title: str, id_: str, share: float, seed: int) -> DataFrame:
    """``test`` for max(1, round(n * share)) rows of each title, but never all of them."""
    counts = title_counts(rows, title)
    k = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * share)), F.col("n") - 1)
    by = Window.partitionBy(title).orderBy(chance(seed, F.col(id_)), id_)
    return rows.join(counts, title).withColumn("test", F.row_number().over(by) <= k).drop("n")


def keep_negatives(rows: DataFrame, negative: Column, absent: Column, p: float, *key) -> DataFrame:
    """All positives; negatives with chance ``p``, a fifth of it where the field is absent."""
    limit = F.when(absent, F.lit(0.2 * p)).otherwise(F.lit(p)) * 10000
    return rows.filter(~negative | (bucket(*key) < limit))


def first_copies(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def frequency_threshold(counts: DataFrame, title: str, q: float) -> DataFrame:
    """(title, threshold): the count at rank ceil(q * n) of the sorted counts ``n``."""
    return counts.groupBy(title).agg(F.sort_array(F.collect_list("n")).alias("v")).select(title, F.expr(f"v[cast(ceil({q} * size(v)) as int) - 1]").alias("threshold"))


def length_priors(values: DataFrame, key: str) -> DataFrame:
    """(key, n, p25, p50, p75, sigma) of value lengths: elements at floor(q * (n - 1)); keys with three values or more."""
    v = values.select(key, F.length("value").alias("len"))
    rows = v.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("len")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    at = lambda q: F.max(F.when(F.col("rn") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("len")))
    out = rows.groupBy(key, "n").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75")).filter("n >= 3")
    return out.withColumn("sigma", F.round(F.greatest(F.lit(1.0), (F.col("p75") - F.col("p25")) / 1.349), 6))


def shards(rows: DataFrame, order: str, budget: int, spread: int = 64) -> DataFrame:
    """``rows`` with ``shard`` names, greedy in ``order``: no shard exceeds ``budget`` bytes of JSON, unless one row does.

    A first pass sorts the rows and adds up their bytes; each ``spread`` budgets of that sum are a range, whatever the
    values of ``order`` are, and begin a shard of their own.  So ranges are dealt apart, no task holds more than one at a
    time, and at most one shard in ``spread`` is left part empty by it.  Names are the range's number and one within it.
    """
    size = F.octet_length(F.to_json(F.struct(*rows.columns))).cast("long")
    at = rows.select(F.struct(*rows.columns).alias("row"), size.alias("size"), F.col(order).alias("_order")).orderBy("_order").withColumn("i", F.monotonically_increasing_id())
    at = staged(at.withColumn("part", F.shiftright("i", 33)).drop("_order"))
    parts = at.groupBy("part").agg(F.sum("size").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    at = at.join(before, "part").withColumn("range", F.floor((F.col("before") + upto - F.col("size")) / (budget * spread)))
    r = at.select("range", F.struct("i", "size", "row").alias("x"))
    packed = r.groupBy("range").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    packed = packed.select("range", F.posexplode(pack(F.col("xs"), lambda x: x["size"], budget)).alias("n", "own")).select("range", "n", F.explode("own").alias("x"))
    return packed.select("x.row.*", F.concat_ws("-", F.col("range").cast("string"), F.col("n").cast("string")).alias("shard"))


def balanced_separators(rows: DataFrame, group: str, order: str, choice: Column) -> DataFrame:
    """``rows`` with ``separator``: blank where ``choice``, else the less used of two colons so far in the ``group``, the wide one first."""
    before = F.count(F.when(~choice, 1)).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("separator", F.when(choice, F.lit(" ")).when(before % 2 == 0, F.lit("：")).otherwise(F.lit(":")))


def scorer_queries(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, query): what a scorer's context is searched by: the title, then each key with its aliases, in order.

    From records(id, ord, title, key) and aliases(title, key, alias, ord); keys without aliases stand alone.
    """
    known = aliases.groupBy("title", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]), " ").alias("more"))
    rows = records.join(known, ["title", "key"], "left").select("id", "title", F.struct("ord", F.concat_ws(" ", "key", "more").alias("x")).alias("x"))
    listed = rows.groupBy("id").agg(F.min_by("title", "x.ord").alias("title"), F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("id", F.concat_ws(" ", "title", F.array_join(F.transform("xs", lambda x: x["x"]), " ")).alias("query"))


def shown_examples(chunks: Column, limit: int = 500) -> Column:
    """Examples of a scorer's context: each chunk's first ``limit`` characters, with an ellipsis where more follow."""
    return F.transform(chunks, lambda c: F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the characters of two texts; 0 if one is empty."""
    x, y = (F.array_distinct(F.split(c, "")) for c in (a, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, tile: int = 4096, parts: int = 24) -> DataFrame:
    """(query_id, rank, vec_id, score): the k most similar other vectors by cosine, of rows (vec_id, embedding).

    Blocks of about ``block`` queries meet tiles of about ``tile`` vectors as matrices, in at most ``parts`` squared tasks;
    a task shuffles the best of all its tiles for each of its queries.  Vectors that are null, hold nulls, have no length
    or another number of components have a null score, the last.
    """
    bound_batches(vectors.sparkSession)
    schema = vectors.schema
    id_ = schema["vec_id"].dataType.simpleString()
    kind = "float" if schema["embedding"].dataType.simpleString() == "array<float>" else "double"

    def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
        rows = rows.filter("vec_id is not null").select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
        n = max(1, -(-rows.count() // size))
        lists = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("n")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))
        blocks = lists.mapInArrow(packed, f"n long, ids array<{id_}>, sizes array<int>, data binary")
        m = min(parts, -(-n // 2))
        return blocks.repartitionById(m, (F.col("n") % m).cast("int")).toDF(*(f"{name}_{c}" for c in blocks.columns))

    pairs = dealt(vectors, tile, "vs").hint("shuffle_replicate_nl").crossJoin(dealt(queries, block, "qs"))
    best = pairs.mapInArrow(best_of(k, "f4" if kind == "float" else "f8"), f"query_id {id_}, vec_id {id_}, score double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
