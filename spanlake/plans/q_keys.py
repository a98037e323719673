"""Queries of assembly, dictionaries, curation and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble as A
from ..operators import coverage as V
from ..operators import curate as C
from ..operators import keys as K
from . import bindings as B
from .q_text import q
from .registry import query, table

def std(x: str) -> str:
    """SQL of a key's canonical form."""
    return f"regexp_replace(translate({x}, '：（）', ':()'), {q(T.SPACE_CLASS)}, '', 'g')"


ANN_SQL = """ann AS (SELECT l_orderkey AS task, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 4 = 0 AS cancelled,
    l_suppkey % 5 AS updated_at, l_partkey % 3 AS created_at, l_partkey AS body FROM lineitem)"""


def annotations(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task"), F.row_number().over(by).alias("pos"), (F.col("l_partkey") % 4 == 0).alias("cancelled"),
        (F.col("l_suppkey") % 5).alias("updated_at"), (F.col("l_partkey") % 3).alias("created_at"), F.col("l_partkey").alias("body"),
    )


@query("d1_latest_annotation", f"WITH {ANN_SQL} SELECT task, pos, body FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY cancelled, updated_at DESC, created_at DESC, pos DESC) AS rn FROM ann) WHERE rn = 1")
def d1(spark, d):
    return A.latest(annotations(spark, d)).select("task", "pos", "body")


@query("d1_last_annotation", f"WITH {ANN_SQL} SELECT task, max(pos) AS pos, max_by(body, pos) AS body FROM ann WHERE NOT cancelled GROUP BY task")
def d1_last(spark, d):
    return A.latest(annotations(spark, d), "last").select("task", "pos", "body")


REL_SQL = """e AS (SELECT conv_id AS doc, turn AS id, CASE WHEN turn % 2 = 0 THEN 'KEY' ELSE 'VALUE' END AS type, turn * 100 AS s, turn * 100 + 9 AS e, role || (turn % 4) AS text FROM conversations
), r AS (SELECT conv_id AS doc, turn - turn % 2 AS from_id, turn + conv_id % 3 AS to_id, turn AS ord FROM conversations WHERE conv_id % 4 <> 0)"""


def related(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn")
    e = c.select(F.col("conv_id").alias("doc"), t.alias("id"), F.when(t % 2 == 0, "KEY").otherwise("VALUE").alias("type"), (t * 100).alias("start"), (t * 100 + 9).alias("end"), F.concat("role", (t % 4).cast("string")).alias("text"))
    r = c.filter("conv_id % 4 <> 0").select(F.col("conv_id").alias("doc"), (t - t % 2).alias("from_id"), (t + F.col("conv_id") % 3).alias("to_id"), t.alias("ord"))
    return e, r


@query("d2_by_relation", f"""WITH {REL_SQL}, l AS (SELECT doc, from_id, max_by(to_id, ord) AS to_id FROM r GROUP BY ALL
), j AS (SELECT k.doc, k.text AS key, coalesce(v.text, '') AS value, coalesce(v.s, k.e) AS s, coalesce(v.e, k.e) AS e, k.s AS ks FROM e k LEFT JOIN l ON l.doc = k.doc AND l.from_id = k.id LEFT JOIN e v ON v.doc = k.doc AND v.id = l.to_id WHERE k.type = 'KEY' AND (l.to_id IS NULL OR v.type = 'VALUE'))
SELECT doc, key, max_by(value, ks) AS value, max_by(s, ks) AS "start", max_by(e, ks) AS "end" FROM j GROUP BY ALL""")
def d2(spark, d):
    return A.by_relation(*related(spark, d))


@query("d3_by_place", f"""WITH {B.DIALOG_SQL}, o AS (SELECT *, last_value(CASE WHEN type = 'KEY' THEN "start" END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY "start", "end") AS k FROM dialog WHERE type <> 'HOSPITAL'
), named AS (SELECT o.doc, kk.text AS key, coalesce(min(CASE WHEN o.type = 'VALUE' THEN o."start" END), any_value(kk."end")) AS s, coalesce(max(CASE WHEN o.type = 'VALUE' THEN o."end" END), any_value(kk."end")) AS e, sum((o.type = 'VALUE')::INT)::BIGINT AS n
    FROM o JOIN dialog kk ON kk.doc = o.doc AND kk."start" = o.k AND kk.type = 'KEY' GROUP BY o.doc, kk.text, o.k)
SELECT doc, key, s AS "start", e AS "end", n AS "values" FROM named
UNION ALL SELECT doc, '{A.STUB}' || row_number() OVER (PARTITION BY doc ORDER BY "start", "end"), "start", "end", 1 FROM o WHERE k IS NULL
UNION ALL SELECT doc, '{A.HOSPITAL}', min("start"), min_by("end", "start"), 1 FROM dialog WHERE type = 'HOSPITAL' GROUP BY doc""")
def d3(spark, d):
    return A.by_place(B.dialog(spark, d))


@query("d5_joined_values", f"""WITH {B.DIALOG_SQL}, o AS (SELECT *, coalesce(last_value(CASE WHEN type = 'KEY' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY "start", "end"), '') AS key FROM dialog WHERE type <> 'HOSPITAL')
SELECT doc, key, coalesce(string_agg(CASE WHEN type = 'VALUE' THEN text END, '；' ORDER BY "start"), '') AS value FROM o GROUP BY ALL""")
def d5(spark, d):
    return A.joined_values(B.dialog(spark, d))


@query("d10_longest_by_label", f"""WITH {B.DIALOG_SQL} SELECT doc, type, max_by(text, length(text) * 1000000000 + "start") AS text FROM dialog GROUP BY ALL""")
def d10(spark, d):
    return A.longest_by_label(B.dialog(spark, d))


@query("d11_clean_aliases", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN trim(p_name) <> '' AND trim(p_brand) <> '' THEN 1 ELSE 0 END AS n FROM part")
def d11(spark, d):
    m = F.map_from_arrays(F.array(F.lit("a"), F.concat(F.lit(" "), "p_name")), F.array(F.when(F.col("p_size") % 3 == 0, " ").otherwise("x "), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", F.size(A.clean_aliases(m)).alias("n"))


PAIR_SQL = "rec AS (SELECT doc_id AS id, 'k' || (i * 3) AS key, split_part(text, ' ', i) AS value FROM documents, range(1, 4) r(i)), txt AS (SELECT doc_id AS id, 'k3：' || split_part(text, ' ', 1) || ' a6:' || split_part(text, ' ', 2) || ' k9' || text AS body FROM documents)"


@query("d8_locate_pairs", f"""WITH {PAIR_SQL}, nm AS (SELECT id, key, value, unnest(CASE WHEN key = 'k6' THEN ['k6', 'a6'] ELSE [key] END) AS name FROM rec
), f AS (SELECT *, unnest([name || '：', name || ':', name]) AS form, unnest([0, 1, 2]) AS sep FROM nm
), h AS (SELECT f.*, strpos(body, form) AS k, body FROM f JOIN txt USING (id) WHERE contains(body, form)
), b AS (SELECT *, row_number() OVER (PARTITION BY id, key, value ORDER BY (sep = 2)::INT, length(name) DESC, sep, name) AS rn FROM h
), v AS (SELECT *, strpos(substr(body, k + length(form)), value) AS p FROM b WHERE rn = 1), ok AS (SELECT * FROM v WHERE p > 0 AND value <> ''
), w AS (SELECT id FROM (SELECT id, count(*) AS n FROM rec GROUP BY id) JOIN (SELECT id, count(*) AS m FROM ok GROUP BY id) USING (id) WHERE n = m)
SELECT id, key, form, k - 1 AS key_start, k + length(form) + p - 2 AS value_start FROM ok WHERE id IN (SELECT id FROM w)""")
def d8(spark, d):
    docs = table(spark, d, "documents")
    word = lambda i: F.coalesce(F.get(F.split("text", " "), F.lit(i)), F.lit(""))
    rec = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(*(F.struct(F.lit(f"k{i * 3}").alias("key"), word(i - 1).alias("value")) for i in (1, 2, 3)))).alias("x")).select("id", "x.*")
    txt = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("k3："), word(0), F.lit(" a6:"), word(1), F.lit(" k9"), "text").alias("body"))
    return A.locate_pairs(rec, spark.createDataFrame([("k6", "a6")], "key string, alias string"), txt)


@query("f1_canonical_records", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, al AS (SELECT title, alias AS key, min_by(key, struct_pack(o := ord, k := key)) AS loc FROM (SELECT title, key AS alias, alias AS key, ord FROM aliases) GROUP BY ALL
), gl AS (SELECT alias AS key, min_by(key, struct_pack(o := ord, k := key)) AS gk FROM (SELECT title, key AS alias, alias AS key, ord FROM aliases) GROUP BY ALL
), c AS (SELECT id, records.title, coalesce(loc, gk, records.key) AS key, value, min(records.ord) AS ord FROM records LEFT JOIN al ON al.title = records.title AND al.key = records.key LEFT JOIN gl ON gl.key = records.key GROUP BY ALL)
SELECT id, title, key, string_agg(value, '；' ORDER BY ord) AS value FROM c GROUP BY ALL""")
def f1(spark, d):
    swapped = B.aliases(spark, d).select("title", F.col("alias").alias("key"), F.col("key").alias("alias"), "ord")
    return K.canonical_records(B.records(spark, d), swapped)


HALF_SQL = f"{B.KEYS_SQL}, {B.RECORDS_SQL}, half AS (SELECT * FROM keys WHERE ord % 2 = 0)"


@query("f8_allowed_fields", f"WITH {HALF_SQL} SELECT id, ord, key FROM records r WHERE EXISTS (SELECT 1 FROM half h WHERE h.title = r.title AND {std("h.key")} = {std("r.key")})")
def f8(spark, d):
    return K.allowed(B.records(spark, d), B.keys(spark, d).filter("ord % 2 = 0")).select("id", "ord", "key")


@query("f9_missing_keys", f"WITH {HALF_SQL}, t AS (SELECT DISTINCT id, title FROM records WHERE id % 10 = id % 10) SELECT id, title, key FROM t JOIN half USING (title) EXCEPT SELECT id, title, key FROM records")
def f9(spark, d):
    return K.missing_keys(B.records(spark, d), B.keys(spark, d).filter("ord % 2 = 0"))


@query("f10_replace_titles", f"WITH {B.KEYS_SQL}, other AS (SELECT CASE WHEN ord % 3 = 0 THEN title ELSE 'new' END AS title, key, -ord AS ord FROM keys WHERE title < 'Brand#3') SELECT title, key, ord FROM keys WHERE title NOT IN (SELECT title FROM other) UNION ALL SELECT * FROM other")
def f10(spark, d):
    k = B.keys(spark, d)
    other = k.filter("title < 'Brand#3'").select(F.when(F.col("ord") % 3 == 0, F.col("title")).otherwise("new").alias("title"), "key", (-F.col("ord")).alias("ord"))
    return K.replace_titles(k, other)


@query("f11_cosine_top", """WITH qs AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (
    SELECT query_id, vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS score FROM embeddings, qs WHERE vec_id <> query_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def f11(spark, d):
    e = table(spark, d, "embeddings")
    return C.top_similar(e, e.filter("vec_id % 100 = 0"), 5)


@query("f13_neighbours", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, p AS (SELECT title, key, row_number() OVER (PARTITION BY title ORDER BY ord, key) AS place FROM keys
), r AS (SELECT id, title, key, min_by(value, ord) AS value FROM records GROUP BY ALL), x AS (SELECT * FROM r JOIN p USING (title, key))
SELECT a.id, a.title, a.key, left(string_agg(b.key || '：' || b.value, '；' ORDER BY b.place), 500) AS around FROM x a JOIN x b ON a.id = b.id AND a.title = b.title AND abs(a.place - b.place) <= 2 AND a.place <> b.place GROUP BY ALL""")
def f13(spark, d):
    return K.neighbours(B.records(spark, d), B.keys(spark, d))


@query("f14_categories", """WITH kw(category, word) AS (VALUES ('en', 'the'), ('en', 'and'), ('de', 'und'), ('de', 'der'), ('fr', 'les'), ('fr', 'des')), w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents)
SELECT category, doc_id, count(DISTINCT word) AS hits FROM w JOIN kw USING (word) GROUP BY ALL HAVING count(DISTINCT word) >= 2""")
def f14(spark, d):
    kw = spark.createDataFrame([("en", "the"), ("en", "and"), ("de", "und"), ("de", "der"), ("fr", "les"), ("fr", "des")], "category string, word string")
    return K.matching_categories(table(spark, d, "documents"), kw, 2)


FIELDS_SQL = f"{B.RECORDS_SQL}, old AS (SELECT id, key, min(value) AS value FROM records GROUP BY ALL), new AS (SELECT id, key, CASE WHEN id % 3 = 0 THEN value || '!' ELSE value END AS value FROM old WHERE id % 7 <> 0)"


def fields(spark, d):
    old = B.records(spark, d).groupBy("id", "key").agg(F.min("value").alias("value"))
    new = old.filter("id % 7 <> 0").withColumn("value", F.when(F.col("id") % 3 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return old, new


@query("f16_field_changes", f"WITH {FIELDS_SQL} SELECT id, key, old.value AS old, new.value AS new FROM old FULL JOIN new USING (id, key) WHERE old.value IS DISTINCT FROM new.value")
def f16(spark, d):
    return K.changes(*fields(spark, d))


@query("f17_merged_back", f"WITH {FIELDS_SQL} SELECT id, key, coalesce(new.value, old.value) AS value FROM old LEFT JOIN new USING (id, key)")
def f17(spark, d):
    return K.merged_back(*fields(spark, d))


@query("f18_merge_aliases", f"""WITH {B.KEYS_SQL}, s AS (SELECT title, key, alias, ord, 0 AS rank FROM aliases WHERE ord % 2 = 0 UNION ALL SELECT title, key, lower(alias), ord, 1 FROM aliases UNION ALL SELECT title, key, alias, ord, 2 FROM aliases
), x AS (SELECT title, key, {std("alias")} AS std, min(struct_pack(rank := rank, ord := ord, alias := alias)) AS x FROM s WHERE {std("alias")} <> {std("key")} GROUP BY ALL)
SELECT title, key, x.alias AS alias, row_number() OVER (PARTITION BY title, key ORDER BY x) AS ord FROM x""")
def f18(spark, d):
    a = B.aliases(spark, d)
    return K.merge_aliases([a.filter("ord % 2 = 0"), a.withColumn("alias", F.lower("alias")), a])


@query("f21_found_strings", """SELECT item_id, CASE WHEN contains(text, w) THEN strpos(text, w) - 1 ELSE 0 END AS "start", CASE WHEN contains(text, w) THEN strpos(text, w) - 1 ELSE 0 END + length(w) AS "end" FROM (SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN 'nowhere' ELSE split_part(text, ' ', 4) END AS w FROM benchmark)""")
def f21(spark, d):
    w = F.when(F.col("item_id") % 3 == 0, "nowhere").otherwise(F.coalesce(F.get(F.split("text", " "), F.lit(3)), F.lit("")))
    rows = table(spark, d, "benchmark").withColumn("w", w).withColumn("p", F.expr("instr(text, w)"))
    s = F.when(F.col("p") > 0, F.col("p") - 1).otherwise(0)
    return rows.select("item_id", s.alias("start"), (s + F.length("w")).alias("end"))


@query("g10_length_priors", f"""WITH {B.RECORDS_SQL}, r AS (SELECT key, length(value) AS len, row_number() OVER (PARTITION BY key ORDER BY length(value)) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM records
), p AS (SELECT key, n, max(CASE WHEN rn = floor(0.25 * (n - 1)) THEN len END) AS p25, max(CASE WHEN rn = floor(0.5 * (n - 1)) THEN len END) AS p50, max(CASE WHEN rn = floor(0.75 * (n - 1)) THEN len END) AS p75 FROM r GROUP BY ALL)
SELECT *, round(greatest(1.0, (p75 - p25) / 1.349), 6) AS sigma FROM p WHERE n >= 3""")
def g10(spark, d):
    return C.length_priors(B.records(spark, d), "key")


@query("g14_dataset_stats", f"WITH {B.RECORDS_SQL} SELECT count(DISTINCT id) AS rows, sum(length(value))::BIGINT AS chars, count(DISTINCT key) AS keys, count(DISTINCT title) AS titles, round(count(*) / count(DISTINCT id), 6) AS keys_per_row FROM records")
def g14(spark, d):
    r = B.records(spark, d)
    return r.agg(F.count_distinct("id").alias("rows"), F.sum(F.length("value")).alias("chars"), F.count_distinct("key").alias("keys"), F.count_distinct("title").alias("titles"), F.round(F.count("*") / F.count_distinct("id"), 6).alias("keys_per_row"))


@query("g15_title_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def g15(spark, d):
    return C.title_counts(table(spark, d, "events"), "event_type")


@query("g16_targets", "SELECT list_sort(list(n))[1 + len(list(n)) // 2] AS median, round_even(avg(n), 0)::BIGINT AS mean FROM (SELECT source, count(*) AS n FROM documents GROUP BY ALL)")
def g16(spark, d):
    counts = C.title_counts(table(spark, d, "documents"), "source")
    return C.upper_median(counts).withColumnRenamed("target", "median").crossJoin(C.mean_count(counts).withColumnRenamed("target", "mean"))


@query("g17_frequency_threshold", f"WITH {B.RECORDS_SQL}, c AS (SELECT title, key, count(*) AS n FROM records GROUP BY ALL) SELECT title, list_sort(list(n))[ceil(0.8 * len(list(n)))::INT] AS threshold FROM c GROUP BY title")
def g17(spark, d):
    return C.frequency_threshold(B.records(spark, d).groupBy("title", "key").agg(F.count("*").alias("n")), "title", 0.8)


@query("g18_alias_coverage", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, u AS (SELECT title, count(*) AS universe FROM keys GROUP BY title), s AS (SELECT title, count(DISTINCT key) AS seen FROM records GROUP BY title)
SELECT title, universe, coalesce(seen, 0) AS seen, round(coalesce(seen, 0) / universe, 6) AS coverage FROM u LEFT JOIN s USING (title)""")
def g18(spark, d):
    u = B.keys(spark, d).groupBy("title").agg(F.count("*").alias("universe"))
    s = B.records(spark, d).groupBy("title").agg(F.count_distinct("key").alias("seen"))
    n = F.coalesce("seen", F.lit(0).cast("long"))
    return u.join(s, "title", "left").select("title", "universe", n.alias("seen"), F.round(n / F.col("universe"), 6).alias("coverage"))


@query("g19_value_loss", "SELECT conv_id, count(*) FILTER (NOT contains(body, word)) AS lost, count(*) AS n FROM (SELECT conv_id, upper(left(text, 1)) || substr(text, 2) AS body, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY ALL")
def g19(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.concat(F.upper(F.left("text", F.lit(1))), F.expr("substring(text, 2)")).alias("body"), F.explode(F.split("text", " ")).alias("word"))
    return rows.groupBy("conv_id").agg(F.count_if(~F.contains("body", F.col("word"))).alias("lost"), F.count("*").alias("n"))


@query("g20_length_stats", "SELECT lang, count(*) AS n, min(length(text))::BIGINT AS lo, max(length(text))::BIGINT AS hi, round(avg(length(text)), 6) AS mean, round(avg((length(text) > 4000)::INT), 6) AS truncated FROM documents GROUP BY lang")
def g20(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.round(F.avg(n), 6).alias("mean"), F.round(F.avg((n > 4000).cast("int")), 6).alias("truncated"))


@query("g21_top_keys", f"WITH {B.RECORDS_SQL} SELECT key, count(*) AS n FROM records GROUP BY key ORDER BY n DESC, key LIMIT 10")
def g21(spark, d):
    return B.records(spark, d).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query("h1_cap_per_title", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def h1(spark, d):
    return C.cap_per_title(table(spark, d, "documents"), "source", ["doc_id"], 5).select("doc_id", "source")


@query("h2_downsample", "WITH t AS (SELECT round_even(avg(n), 0) AS target FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) AS rn FROM events), t WHERE rn <= target")
def h2(spark, d):
    return C.downsample(table(spark, d, "events"), "event_type", "event_id", 7).select("event_id", "event_type")


@query("h3_upsample", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT list_sort(list(n))[1 + len(list(n)) // 2] AS target FROM c), r AS (SELECT doc_id, lang, n, target, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) - 1 AS rn FROM documents JOIN c USING (lang), t)
SELECT doc_id, lang, unnest(range(CASE WHEN n >= target THEN 1 ELSE (target - 1 - rn) // n + 1 END))::INT AS copy FROM r""")
def h3(spark, d):
    return C.upsample(table(spark, d, "documents"), "lang", "doc_id").select("doc_id", "lang", "copy")


@query("h4_quotas", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) < 60) SELECT source, doc_id, ((60 - n) // n + (row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) <= (60 - n) % n)::INT)::BIGINT AS quota FROM documents JOIN c USING (source)")
def h4(spark, d):
    return C.quotas(table(spark, d, "documents"), "source", "doc_id", 60)


@query("h6_ratio_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def h6(spark, d):
    return C.ratio_split(table(spark, d, "documents"), "doc_id", [("train", 0.8), ("val", 0.1), ("test", 0.1)], 3).select("doc_id", "split")


@query("h7_stratified_split", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5:' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, p <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS test FROM r")
def h7(spark, d):
    return C.stratified_split(table(spark, d, "documents"), "lang", "doc_id", 0.2, 5).select("doc_id", "lang", "test")


BUCKET = "('0x' || substr(md5({0}), 1, 8))::BIGINT % 10000"


@query("h8_hash_split", f"SELECT doc_id, {BUCKET.format(chr(39) + 'ridx:' + chr(39) + ' || doc_id')} < 9000 AS train FROM documents")
def h8(spark, d):
    return table(spark, d, "documents").select("doc_id", (C.bucket("ridx:", F.col("doc_id")) < 9000).alias("train"))


@query("h10_keep_negatives", f"SELECT event_id FROM events WHERE NOT (event_type <> 'purchase') OR {BUCKET.format('event_id::VARCHAR')} < CASE WHEN value < 1 THEN 0.2 * 0.3 ELSE 0.3 END * 10000")
def h10(spark, d):
    return C.keep_negatives(table(spark, d, "events"), F.col("event_type") != "purchase", F.col("value") < 1, 0.3, F.col("event_id")).select("event_id")


@query("h11_inverse_weights", "SELECT doc_id, 1.0 / count(*) OVER (PARTITION BY source) AS weight FROM documents")
def h11(spark, d):
    rows = table(spark, d, "documents")
    return rows.join(rows.groupBy("source").agg((1.0 / F.count("*")).alias("weight")), "source").select("doc_id", "weight")


@query("h12_alias_plan", f"WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, a AS (SELECT title, key, list(alias ORDER BY ord, alias) AS a FROM aliases GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY title, key ORDER BY id, ord) AS n FROM records) SELECT id, ord, title, key, a[1 + (n - 1) % len(a)] AS shown FROM r JOIN a USING (title, key)")
def h12(spark, d):
    return V.alias_plan(B.records(spark, d), B.aliases(spark, d))


@query("h16_key_order", f"WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, r AS (SELECT id, title, key, min(ord) AS own FROM records GROUP BY ALL) SELECT id, list(key ORDER BY coalesce(h.ord, 1099511627776 + own), key) AS keys FROM r LEFT JOIN (SELECT * FROM keys WHERE ord % 2 = 0) h USING (title, key) GROUP BY id".replace("list(key ORDER BY coalesce(h.ord, 1099511627776 + own), key) AS keys", "array_to_string(list(key ORDER BY coalesce(h.ord, 1099511627776 + own), key), '|') AS keys"))
def h16(spark, d):
    return K.by_structure(B.records(spark, d), B.keys(spark, d).filter("ord % 2 = 0")).select("id", F.array_join("keys", "|").alias("keys"))


@query("i1_first_copies", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, md5(lower(regexp_replace(text, " + q(T.SPACE_CLASS + "+") + ", '', 'g'))) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def i1(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", T.fingerprint(F.col("text")).alias("print"))
    return C.first_copies(rows, ["lang", "print"], ["doc_id"]).select("doc_id")


@query("i2_new_rows", "SELECT b.item_id FROM benchmark b WHERE md5(lower(regexp_replace(b.text, " + q(T.SPACE_CLASS + "+") + ", '', 'g'))) NOT IN (SELECT md5(lower(regexp_replace(text, " + q(T.SPACE_CLASS + "+") + ", '', 'g'))) FROM documents)")
def i2(spark, d):
    mark = lambda rows: rows.withColumn("print", T.fingerprint(F.col("text")))
    return mark(table(spark, d, "benchmark")).join(mark(table(spark, d, "documents")), "print", "left_anti").select("item_id")


@query("i3_key_sets", f"WITH {B.KEYS_SQL}, a AS (SELECT title, key FROM keys WHERE ord % 3 <> 0), b AS (SELECT title, key FROM keys WHERE ord % 2 = 0) SELECT 'both' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def i3(spark, d):
    k = B.keys(spark, d)
    a, b = k.filter("ord % 3 <> 0").select("title", "key"), k.filter("ord % 2 = 0").select("title", "key")
    return a.intersect(b).select(F.lit("both").alias("op"), "*").unionByName(a.subtract(b).select(F.lit("only").alias("op"), "*"))


@query("j2_similarity", "SELECT doc_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS score FROM (SELECT doc_id, list_distinct(string_split(text, '')) AS x, list_distinct(string_split(source || lang, '')) AS y FROM documents)")
def j2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(C.similarity(F.col("text"), F.concat("source", "lang")), 6).alias("score"))


@query("a10_byte_shards", None)
def a10(spark, d):
    return C.shards(table(spark, d, "orders"), "o_orderkey", 100_000).groupBy("shard").agg(F.count("*").alias("n"))


@query("a3_dynamic_fields", "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def a3(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))
