"""What of values and aliases a composed report shows, and choices among a record's fields.

Tables as in ``keys``: aliases (title, key, alias, ord), structures (title, key, ord), records (id, ord, title, key, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .curate import bucket
from .fold import once
from .lists import by_doc


def alias_plan(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, ord, title, key, shown): the k-th record of a title's key shows its k-th alias, in turn."""
    a = aliases.groupBy("title", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]).alias("a"))
    r = records.withColumn("n", F.row_number().over(Window.partitionBy("title", "key").orderBy("id", "ord")))
    return r.join(a, ["title", "key"]).select("id", "ord", "title", "key", F.get("a", (F.col("n") - 1) % F.size("a")).alias("shown"))


def alias_coverage(aliases: DataFrame, records: DataFrame, shown: DataFrame, sample: int = 20) -> DataFrame:
    """(title, universe, seen, coverable, coverage, coverable_coverage, uncoverable) of a title's aliases.

    ``seen`` are those of shown(title, shown), ``coverable`` those whose key occurs in the title's records; ``uncoverable``
    lists the first ``sample`` others.  Shown names that are no alias of the title don't count.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = records.select("title", "key", F.lit(True).alias("has")).distinct()
    seen = shown.select("title", F.col("shown").alias("alias"), F.lit(True).alias("seen")).distinct()
    one = aliases.select("title", "key", "alias").join(has, ["title", "key"], "left").groupBy("title", "alias").agg(F.max(yes(F.col("has"))).alias("has"))
    one = one.join(seen, ["title", "alias"], "left").select("title", "alias", "has", yes(F.col("seen")).alias("seen"))
    out = one.groupBy("title").agg(
        F.count("*").alias("universe"), F.count_if("seen").alias("seen"), F.count_if("has").alias("coverable"),
        F.slice(F.sort_array(F.collect_list(F.when(~F.col("has"), F.col("alias")))), 1, sample).alias("uncoverable"),
    )
    share = lambda n: F.when(n == 0, 1.0).otherwise(F.round(F.col("seen") / n, 6))
    return out.select("title", "universe", "seen", "coverable", share(F.col("universe")).alias("coverage"), share(F.col("coverable")).alias("coverable_coverage"), "uncoverable")


def _plain(x: Column) -> Column:
    return T.tidy(T.one_line(x))


def lost_values(reports: DataFrame, records: DataFrame) -> DataFrame:
    """(id, title, total, lost): of a record's non-empty values those that reports(id, report) lacks, both as tidy lines.

    A record's values meet its report as one list, so the report isn't repeated for each; without a report all are lost.
    """
    values = records.groupBy("id", "title").agg(F.collect_list(F.struct("ord", "key", _plain(F.col("value")).alias("value"))).alias("v"), F.count("value").alias("total"))
    texts = reports.select("id", _plain(F.coalesce("report", F.lit(""))).alias("report"))
    lost = F.filter("v", lambda x: (x["value"] != "") & ~F.contains(F.coalesce("report", F.lit("")), x["value"]))
    return values.join(texts, "id", "left").select("id", "title", "total", F.sort_array(lost).alias("lost"))


def alias_mismatches(reports: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, title, alias, key): shown(id, title, key, shown) aliases that the text of reports(id, report) doesn't hold."""
    listed = shown.filter("shown <> ''").groupBy("id", "title").agg(F.collect_set(F.struct(F.col("shown").alias("alias"), "key")).alias("a"))
    absent = F.filter("a", lambda x: ~F.contains(F.coalesce("report", F.lit("")), x["alias"]))
    return listed.join(reports.select("id", "report"), "id", "left").select("id", "title", F.explode(absent).alias("x")).select("id", "title", "x.alias", "x.key")


def selected_fields(records: DataFrame, mode: str, added: DataFrame | None = None, custom: Sequence[str] = (), titles: Sequence[str] | None = None, exclude: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """(id, title, key): the fields of each record that are to be cleaned.

    ``mode`` is ``added`` (the keys of added(id, key, ord)), ``all``, or ``custom`` (those of ``custom``, in that order).
    Records of titles other than ``titles`` have none; of more than ``cap`` the first ones stay.
    """
    rows = records if titles is None else records.filter(F.col("title").isin(*titles))
    fits = (F.trim("key") != "") & ~F.col("key").isin(*exclude)
    field = ("id", "title", "key", "ord")
    if mode == "added" and added is not None:
        # A record's titles meet its added keys in its row.
        listed = by_doc("id", r=rows.select("id", "title"), a=added.filter(fits).select("id", "key", "ord")).filter("id is not null")
        pair = lambda t, k: F.struct(t["title"].alias("title"), k["key"].alias("key"), k["ord"].alias("ord"))
        fields = once(F.array_distinct("r"), lambda r: F.flatten(F.transform(_firsts(F.col("a"), "key"), lambda k: F.transform(r, lambda t: pair(t, k)))))
    elif mode in ("all", "custom"):
        if mode == "custom":
            rows = rows.withColumn("ord", F.array_position(F.array(*map(F.lit, custom)).cast("array<string>"), F.col("key"))).filter("ord > 0")
        listed = by_doc("id", r=rows.filter(fits).select(*field))
        fields = _firsts(F.col("r"), "title", "key")
    else:
        raise ValueError(f"no such mode, or no table of added keys: {mode}")
    if cap:
        order = lambda x: F.struct(x["ord"].alias("ord"), x["key"].alias("key"), x["title"].alias("title"))
        fields = F.slice(F.array_sort(F.transform(fields, order)), 1, cap)
    return listed.select("id", F.explode(fields).alias("x")).select("id", "x.title", "x.key")


def _firsts(fields: Column, *names: str) -> Column:
    """Each combination of ``names`` among ``fields`` once, with its least ord."""
    order = lambda x: F.struct(*[x[n].alias(n) for n in names], x["ord"].isNull().alias("none"), x["ord"].alias("ord"))
    of = lambda x: F.struct(*[x[n] for n in names])
    return once(F.array_sort(F.transform(fields, order)), lambda s: F.filter(s, lambda x, i: (i == 0) | ~of(x).eqNullSafe(of(F.get(s, i - 1)))))


def limited_keys(keys: DataFrame, cap: int, pick: str = "head", seed: int = 0) -> DataFrame:
    """At most ``cap`` of the rows keys(id, title, key, ord) of a record: the first, or with ``random`` those of a hash order."""
    if pick not in ("head", "random"):
        raise ValueError(f"pick is head or random, not {pick}")
    luck = [F.md5(F.concat_ws(":", F.lit(str(seed)), "title", "id", "key"))] if pick == "random" else []
    return keys.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(*luck, "ord", "key", "title"))).filter((F.col("rn") <= cap) | F.lit(cap <= 0)).drop("rn")


def perturbed(records: DataFrame, structure: DataFrame, drop: float, add: float, least: int, seed: int, variants: int = 1) -> DataFrame:
    """(id, variant, title, key, value): the records as variant 0, and variants of those whose title has a structure.

    In a variant a key of the structure goes with chance ``drop``, one that the record lacks comes, empty, with chance
    ``add``; then absent ones of the structure come, empty, until there are ``least`` keys.  Other keys stay.
    """
    own = records.repartition("id", "title").groupBy("id", "title", "key").agg(F.min_by("value", "ord").alias("value"))
    listed = own.groupBy("id", "title").agg(F.collect_list(F.struct("key", "value")).alias("own"))
    known = structure.filter("key is not null").groupBy("title").agg(F.collect_set("key").alias("known"))
    # A record's keys and its title's meet as lists in one row; only what a variant keeps becomes rows.
    rows = listed.join(known, "title", "left")
    luck = lambda what, at, key: bucket(F.lit(f"{seed}:{what}:"), at, key)
    row = lambda v, key, value: F.struct(v.alias("variant"), key.alias("key"), value.alias("value"))
    once = lambda x, work: F.get(F.transform(F.array(x), work), F.lit(0))  # noqa: E731  # a lambda's variable is worked out once
    absent = F.array_except("known", F.transform("own", lambda x: x["key"]))

    def variant(v: Column) -> Column:
        def marked(at: Column) -> Column:
            ours = lambda x: ~F.coalesce(F.array_contains("known", x["key"]), F.lit(False)) | (luck("drop", at, x["key"]) >= int(drop * 10_000))
            mine = F.transform("own", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), ours(x).alias("stays")))
            new = F.transform(absent, lambda k: F.struct(k.alias("key"), F.lit("").alias("value"), (luck("add", at, k) < int(add * 10_000)).alias("stays")))
            return once(F.concat(mine, new), lambda m: once(F.filter(m, lambda x: x["stays"]), lambda kept: F.when(F.size(kept) < least, F.concat(kept, filled(at, m, F.lit(least) - F.size(kept)))).otherwise(kept)))

        def filled(at: Column, m: Column, n: Column) -> Column:
            out = F.transform(F.filter(m, lambda x: ~x["stays"]), lambda x: F.struct(luck("fill", at, x["key"]).alias("fill"), x["key"].alias("key")))
            return F.transform(F.slice(F.array_sort(out), F.lit(1), n), lambda x: F.struct(x["key"].alias("key"), F.lit("").alias("value"), F.lit(True).alias("stays")))

        return F.transform(once(F.concat(v.cast("string"), F.lit(":"), F.col("id").cast("string"), F.lit(":")), marked), lambda x: row(v, x["key"], x["value"]))

    first = F.transform("own", lambda x: row(F.lit(0), x["key"], x["value"]))
    others = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(variants)), variant)) if variants > 0 else F.slice(first, 1, 0)
    every = F.when(F.col("known").isNotNull() & F.col("id").isNotNull(), F.concat(first, others)).otherwise(first)
    return rows.select("id", "title", F.explode(every).alias("x")).select("id", "x.variant", "title", "x.key", "x.value")


def option_flags(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored(id, key, option, prob) with ``flag``: prob > threshold; a null one is no flag."""
    return scored.withColumn("flag", F.coalesce(F.col("prob") > threshold, F.lit(False)))


def key_sets(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """The (title, key) rows in ``union``, ``intersection`` or ``difference`` of two tables."""
    a, b = a.select("title", "key"), b.select("title", "key")
    return {"union": lambda: a.union(b).distinct(), "intersection": lambda: a.intersect(b), "difference": lambda: a.subtract(b)}[how]()
