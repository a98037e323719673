"""Queries of splits with exact sizes, item separators, dataset statistics and lists of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as P
from . import bindings as B
from .q_text import TOKEN, q
from .registry import query, table

PLACED_SQL = "p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('{seed}:' || o_orderkey), o_orderkey) AS i, count(*) OVER () AS n FROM orders{where})"


@query("h6_eval_split", f"WITH {PLACED_SQL.format(seed=3, where='')} SELECT o_orderkey, CASE WHEN i > n - greatest(1, floor(n * 0.1::DOUBLE)) THEN 'eval' ELSE 'train' END AS split FROM p")
def h6_eval(spark, d):
    return P.eval_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1, 3)


@query("h6_pool_split", f"WITH {PLACED_SQL.format(seed=4, where=' WHERE o_orderkey % 3 = 0')} SELECT o_orderkey, CASE WHEN i <= ceil(n * 0.5::DOUBLE) THEN 'test' ELSE 'val' END AS split FROM p")
def h6_pool(spark, d):
    return P.pool_split(table(spark, d, "orders").select("o_orderkey").filter("o_orderkey % 3 = 0"), "o_orderkey", 0.5, 4)


@query("h6_three_way", f"WITH {PLACED_SQL.format(seed=5, where='')}, f AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM p) SELECT o_orderkey, CASE WHEN i <= a THEN 'train' WHEN i <= a + floor((n - a) * (0.2::DOUBLE / (1 - 0.7::DOUBLE))) THEN 'val' ELSE 'test' END AS split, 0 AS copy FROM f")
def h6_three(spark, d):
    return P.three_way(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.7, 0.2, 5)


@query("h15_item_separators", f"""WITH {B.RECORDS_SQL}, n AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS n FROM records), t AS (SELECT *, unnest([' ', '。', '；', '，']) AS s, unnest(range(4)) AS i FROM n), r AS (SELECT id, ord, n, s, row_number() OVER (PARTITION BY id, ord, n ORDER BY md5('6:' || id || ':' || (n // 4) || ':' || i)) - 1 AS k FROM t)
SELECT id, ord, s AS separator FROM r WHERE k = n % 4""")
def h15_items(spark, d):
    return P.item_separators(B.records(spark, d).select("id", "ord"), "id", "ord", 6)


@query("g14_token_stats", f"""WITH {B.RECORDS_SQL}, r AS (SELECT count(*) AS samples, sum(len(regexp_extract_all(text, {q(TOKEN)})))::BIGINT AS input_tokens, count(DISTINCT source) AS unique_titles FROM documents), k AS (SELECT sum(len(regexp_extract_all(value, {q(TOKEN)})))::BIGINT AS output_tokens, count(DISTINCT key) AS unique_keys, count(*) AS keys FROM records)
SELECT samples, input_tokens, output_tokens, unique_keys, unique_titles, round(keys / samples, 3) AS keys_per_sample FROM r, k""")
def g14_tokens(spark, d):
    docs = table(spark, d, "documents")
    return P.dataset_stats(B.records(spark, d), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("report")))


@query("g20_diagnosis", f"""WITH {B.DIALOG_SQL}, n AS (SELECT len(regexp_extract_all(text, {q(TOKEN)}))::BIGINT AS n FROM documents), e AS (SELECT count(*) FILTER (type = 'VALUE') AS v, count(*) FILTER (type = 'KEY') AS k, count(*) FILTER (type = 'HOSPITAL') AS h FROM dialog
), s AS (SELECT count(*) AS rows, min(n) AS least, max(n) AS most, round(sum(n) / count(*), 1) AS mean, list_sort(list(n))[1 + count(*) // 2] AS median, count(*) FILTER (n > 300) / count(*) AS cut FROM n)
SELECT rows, least, most, mean, median, round(cut, 6) AS cut_share, concat_ws(',', CASE WHEN v < 0.8 * k THEN 'few_values' END, CASE WHEN rows < 1000 THEN 'few_rows' END, CASE WHEN cut > 0.3 THEN 'many_cut' END) AS issues, k AS keys, v AS values_, h AS others FROM s, e""")
def g20_diagnosis(spark, d):
    out = P.diagnosis(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), B.dialog(spark, d), 300)
    of = lambda name: F.coalesce(F.try_element_at("types", F.lit(name)), F.lit(0))
    return out.select("rows", "least", "most", "mean", "median", "cut_share", F.array_join("issues", ",").alias("issues"), of("KEY").alias("keys"), of("VALUE").alias("values_"), of("HOSPITAL").alias("others"))


@query("d4_all_value_lists", f"""WITH {B.DIALOG_SQL}, o AS (SELECT *, last_value(CASE WHEN type = 'KEY' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY "start", "end") AS key FROM dialog WHERE type <> 'HOSPITAL')
SELECT doc, coalesce(key, '(none)') AS key, count(*) FILTER (type = 'VALUE') AS n, coalesce(string_agg(CASE WHEN type = 'VALUE' THEN text END, '|' ORDER BY "start"), '') AS listed FROM o GROUP BY doc, key""")
def d4_all(spark, d):
    return P.value_lists(B.dialog(spark, d)).select("doc", F.coalesce("key", F.lit("(none)")).alias("key"), F.size("values").cast("long").alias("n"), F.array_join("values", "|").alias("listed"))
