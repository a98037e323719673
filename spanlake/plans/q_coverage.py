"""Queries of coverage and of choices among fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as V
from ..operators import curate as C
from . import bindings as B
from .registry import query, table

ALIAS_SQL = f"""{B.KEYS_SQL}, {B.RECORDS_SQL}, al AS (SELECT title, key, alias || ' ' || key AS alias, ord FROM aliases), few AS (SELECT * FROM records
), lists AS (SELECT title, key, list(alias ORDER BY ord, alias) AS a FROM al GROUP BY ALL), turns AS (SELECT *, row_number() OVER (PARTITION BY title, key ORDER BY id, ord) AS n FROM few
), shown AS (SELECT id, ord, title, key, a[1 + (n - 1) % len(a)] AS shown FROM turns JOIN lists USING (title, key))"""


def planned(spark, d):
    a = B.aliases(spark, d).withColumn("alias", F.concat_ws(" ", "alias", "key"))
    few = B.records(spark, d)
    return a, few, V.alias_plan(few, a)


@query("g18_coverable_aliases", f"""WITH {ALIAS_SQL}, x AS (SELECT title, key, alias FROM al UNION ALL SELECT '*', key, alias FROM al), r AS (SELECT title, key FROM few UNION SELECT '*', key FROM few), s AS (SELECT title, shown FROM shown UNION SELECT '*', shown FROM shown
), o AS (SELECT x.title, alias, bool_or(r.key IS NOT NULL) AS has, bool_or(s.shown IS NOT NULL) AS seen FROM x LEFT JOIN r ON r.title = x.title AND r.key = x.key LEFT JOIN s ON s.title = x.title AND s.shown = x.alias GROUP BY ALL
), g AS (SELECT title, count(*) AS universe, count(*) FILTER (seen) AS seen, count(*) FILTER (has) AS coverable, list(alias ORDER BY alias) FILTER (NOT has) AS no FROM o GROUP BY title)
SELECT title, universe, seen, coverable, round(seen / universe, 6) AS coverage, CASE WHEN coverable = 0 THEN 1.0::DOUBLE ELSE round(seen / coverable, 6) END AS coverable_coverage, coalesce(array_to_string(no[1:20], '|'), '') AS uncoverable FROM g""")
def g18(spark, d):
    tables = planned(spark, d)
    everywhere = [t.withColumn("title", F.lit("*")) for t in tables]
    return V.alias_coverage(*tables).unionByName(V.alias_coverage(*everywhere)).withColumn("uncoverable", F.array_join("uncoverable", "|"))


REPORT_SQL = "reports AS (SELECT id, string_agg(value, '；' ORDER BY ord) AS report FROM records WHERE s % 7 <> 0 GROUP BY id)"


def reports(rows, name):
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", name))).alias("x"))
    return listed.select("id", F.array_join(F.transform("x", lambda t: t[name]), "；").alias("report"))


@query("g19_lost_values", f"""WITH {B.RECORDS_SQL}, {REPORT_SQL} SELECT title, count(*) AS total, count(*) FILTER (NOT contains(coalesce(report, ''), value)) AS lost, round(count(*) FILTER (NOT contains(coalesce(report, ''), value)) / count(*), 6) AS rate FROM records LEFT JOIN reports USING (id) GROUP BY title""")
def g19_lost(spark, d):
    r = B.records(spark, d)
    out = V.lost_values(reports(r.filter("s % 7 <> 0"), "value"), r).groupBy("title").agg(F.sum("total").alias("total"), F.sum(F.size("lost")).alias("lost"))
    return out.withColumn("rate", F.round(F.col("lost") / F.col("total"), 6))


@query("g19_alias_mismatches", f"""WITH {ALIAS_SQL}, t AS (SELECT id, string_agg(shown, '；' ORDER BY ord, shown) AS report FROM shown WHERE ord % 3 <> 0 GROUP BY id) SELECT DISTINCT id, title, shown AS alias, key FROM shown LEFT JOIN t USING (id) WHERE NOT contains(coalesce(report, ''), shown)""")
def g19_alias(spark, d):
    shown = planned(spark, d)[2]
    return V.alias_mismatches(reports(shown.filter("ord % 3 <> 0"), "shown"), shown)


@query("f17_selected_fields", f"""WITH {B.RECORDS_SQL}, one AS (SELECT id, title, key, min(ord) AS ord FROM records GROUP BY ALL), m AS (
    SELECT 'all' AS mode, id, title, key, ord FROM one WHERE key <> 'red plate' UNION ALL SELECT 'custom', id, title, key, CASE key WHEN 'hot ring' THEN 1 ELSE 2 END FROM one WHERE key IN ('hot ring', 'small widget') AND title <> 'Brand#1'
    UNION ALL SELECT 'added', t.id, t.title, a.key, a.ord FROM (SELECT DISTINCT id, title FROM records) t JOIN (SELECT id, key, min(ord) AS ord FROM records WHERE s % 3 = 0 GROUP BY ALL) a USING (id))
SELECT mode, id, title, key FROM (SELECT *, row_number() OVER (PARTITION BY mode, id ORDER BY ord, key, title) AS rn FROM m) WHERE mode = 'added' OR rn <= 2""")
def f17(spark, d):
    r = B.records(spark, d)
    parts = [
        V.selected_fields(r, "all", exclude=["red plate"], cap=2), V.selected_fields(r.filter("title <> 'Brand#1'"), "custom", custom=["hot ring", "small widget"], cap=2),
        V.selected_fields(r, "added", added=r.filter("s % 3 = 0")),
    ]
    rows = [p.withColumn("mode", F.lit(m)) for p, m in zip(parts, ("all", "custom", "added"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


LUCK = "('0x' || substr(md5('8:{0}:' || variant || ':' || id || ':' || key), 1, 8))::BIGINT % 10000"


@query("h14_perturbed", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, own AS (SELECT id, title, key, arg_min(value, ord) AS value FROM records GROUP BY ALL), st AS (SELECT DISTINCT title, key FROM keys WHERE ord % 8 = 0
), e AS (SELECT DISTINCT id, title, unnest([1, 2]) AS variant FROM own WHERE title IN (SELECT title FROM st)), h AS (SELECT * FROM e JOIN own USING (id, title)), k AS (SELECT id, title, variant, key FROM e JOIN st USING (title)
), r AS (SELECT id, title, variant, key, h.value, h.value IS NOT NULL AS own, k.key IS NOT NULL AS known FROM h FULL JOIN k USING (id, title, variant, key)
), l AS (SELECT *, CASE WHEN NOT known THEN true WHEN own THEN {LUCK.format('drop')} >= 3000 ELSE {LUCK.format('add')} < 500 END AS stays, {LUCK.format('fill')} AS fill FROM r
), w AS (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY id, title, variant) AS kept, row_number() OVER (PARTITION BY id, title, variant ORDER BY stays, fill, key) AS rn FROM l)
SELECT id, 0 AS variant, title, key, value FROM own UNION ALL SELECT id, variant, title, key, CASE WHEN stays AND own THEN value ELSE '' END FROM w WHERE stays OR rn <= 2 - kept""")
def h14(spark, d):
    return V.perturbed(B.records(spark, d), B.keys(spark, d).filter("ord % 8 = 0"), 0.3, 0.05, 2, 8, 2)


@query("h14_limited_keys", f"""WITH {B.RECORDS_SQL}, o AS (SELECT id, title, key, min(ord) AS ord FROM records GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, key) AS h, row_number() OVER (PARTITION BY id ORDER BY md5('5:' || title || ':' || id || ':' || key), ord, key) AS r FROM o)
SELECT id, title, key, 'head' AS pick FROM k WHERE h <= 2 UNION ALL SELECT id, title, key, 'random' FROM k WHERE r <= 2""")
def h14_limited(spark, d):
    o = B.records(spark, d).groupBy("id", "title", "key").agg(F.min("ord").alias("ord"))
    head, random = (V.limited_keys(o, 2, pick, 5).select("id", "title", "key", F.lit(pick).alias("pick")) for pick in ("head", "random"))
    return head.unionByName(random)


@query("f15_option_flags", "WITH p AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_returnflag AS option, ('0x' || substr(md5('2:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 8))::BIGINT % 10000 / 10000.0 AS prob FROM lineitem) SELECT option, count(*) AS n, count(*) FILTER (prob > 0.7) AS flagged FROM p GROUP BY option")
def f15(spark, d):
    prob = C.bucket("2:", F.col("l_orderkey"), ":", F.col("l_linenumber"), ":", F.col("l_partkey")) / 10_000
    scored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("key"), F.col("l_returnflag").alias("option"), prob.alias("prob"))
    return V.option_flags(scored, 0.7).groupBy("option").agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))


@query("i3_key_union", f"WITH {B.KEYS_SQL} SELECT title, key FROM keys WHERE ord % 3 <> 0 UNION SELECT title, key FROM keys WHERE ord % 2 = 0")
def i3(spark, d):
    k = B.keys(spark, d)
    return V.key_sets(k.filter("ord % 3 <> 0"), k.filter("ord % 2 = 0"), "union")
