"""Queries of composition, samples, decisions and the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mask as K
from ..functions import text as T
from ..operators import compose as P
from ..operators import curate as C
from ..operators import chunk as H
from ..sources import io
from . import bindings as B
from .q_text import TOKEN, q
from .registry import query, table


@query("b26_length_score", f"""WITH {B.RECORDS_SQL}, r AS (SELECT key, length(value) AS len, row_number() OVER (PARTITION BY key ORDER BY length(value)) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM records
), p AS (SELECT key, max(CASE WHEN rn = floor(0.5 * (n - 1)) THEN len END) AS p50, greatest(1.0, (max(CASE WHEN rn = floor(0.75 * (n - 1)) THEN len END) - max(CASE WHEN rn = floor(0.25 * (n - 1)) THEN len END)) / 1.349) AS sigma FROM r GROUP BY key HAVING any_value(n) >= 3)
SELECT id, ord, round(least(1.0, greatest(0.1, CASE WHEN p50 IS NOT NULL THEN exp(-power(abs(length(value) - p50) / (greatest(1.0, 0.8 * round(sigma, 6)) + 1e-6), 2) / 2) ELSE 1 / (1 + power(abs(length(value) - 5) / 5.0 / 0.3, 2)) END)), 6) AS score FROM records LEFT JOIN p USING (key)""")
def b26(spark, d):
    r = B.records(spark, d)
    rows = r.join(C.length_priors(r, "key").select("key", "p50", "sigma"), "key", "left")
    return rows.select("id", "ord", F.round(T.length_score(F.length("value"), F.lit(5.0), F.lit(True), F.col("p50"), F.col("sigma")), 6).alias("score"))


for _name, _make in (("b14a_mask_workplace", K.mask_workplace), ("b14b_mask_case_number", K.mask_case_number), ("b14c_mask_patient", K.mask_patient), ("b14f_mask_name", K.mask_name)):

    @query(_name)
    def masked(spark, d, make=_make):
        cue = F.concat(F.lit("病案号："), F.col("lang"), F.lit("-12345 单位 "), F.col("source"), F.lit(" 患者ID:"), F.col("source"), F.lit(" 姓名：王小明 "), F.col("text"))
        return table(spark, d, "documents").select("doc_id", F.md5(make(cue)).alias("digest"))


@query("e3_within_budget", f"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, {q(TOKEN)})) <= 100 AS fits FROM documents), p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM t WHERE NOT fits)
SELECT doc_id, 0 AS part, md5(text) AS digest FROM t WHERE fits UNION ALL SELECT doc_id, i - 1, md5(p[i]) FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p) WHERE NOT (i = len(p) AND p[i] = '' AND i > 1)""")
def e3(spark, d):
    return P.within_budget(table(spark, d, "documents").select("doc_id", "text"), 100, "\n").select("doc_id", "part", F.md5("body").alias("digest"))


@query("e7_window_samples", r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n]+[ \t\n]*') AS w, length(regexp_extract(text, '^[ \t\n]*')) AS lead, strpos(text, ' the ') - 1 AS s FROM documents), n AS (SELECT *, len(w) AS n FROM t
), x AS (SELECT *, unnest(CASE WHEN n <= 64 THEN [0] ELSE list_filter(range(0, n, 48), lambda i: i = 0 OR i + 16 < n) END) AS i FROM n
), y AS (SELECT *, coalesce(list_sum(list_transform(w[1:i], lambda z: length(z))), 0) + CASE WHEN i > 0 THEN lead ELSE 0 END AS a, CASE WHEN n <= 64 THEN length(text) ELSE list_sum(list_transform(w[i + 1:least(i + 64, n)], lambda z: length(z))) END AS size FROM x)
SELECT doc_id, 'the' AS key, (i // 48)::INT AS chunk, TRUE AS positive FROM y WHERE s >= 0 AND s < a + size AND s + 5 > a UNION ALL SELECT doc_id, 'the', -1, FALSE FROM t WHERE s < 0""")
def e7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    at = F.expr("instr(text, ' the ')") - 1
    return P.window_samples(docs, docs.select("doc_id", F.lit("the").alias("key"), at.alias("start"), (at + 5).alias("end")), 64, 16)


@query("e11_sections", """WITH s AS (SELECT doc_id, string_split(replace(replace(text, 'The ', chr(1) || 'The '), 'That ', chr(1) || 'That '), chr(1)) AS p FROM documents), f AS (SELECT doc_id, CASE WHEN p[1] = '' AND len(p) > 1 THEN p[2:] ELSE p END AS p FROM s)
SELECT doc_id, (i - 1)::INT AS section, CASE WHEN starts_with(p[i], 'The ') THEN 'The ' WHEN starts_with(p[i], 'That ') THEN 'That ' ELSE '' END AS heading, length(p[i])::INT AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM f)""")
def e11(spark, d):
    out = H.sections(table(spark, d, "documents").select("doc_id", "text"), ["The ", "That "])
    return out.select("doc_id", "section", "heading", (F.length("heading") + F.length("body")).alias("n"))


@query("f12_near_duplicates", """WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents), s AS (
    SELECT DISTINCT doc_id, lang, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), k AS (SELECT lang, min(doc_id) AS doc_id FROM (SELECT doc_id, lang, list(g ORDER BY g) AS gs FROM s GROUP BY ALL) GROUP BY lang, gs), r AS (SELECT s.* FROM s JOIN k ON s.doc_id = k.doc_id AND s.lang IS NOT DISTINCT FROM k.lang), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id
), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM r x JOIN r y ON x.g = y.g AND x.lang IS NOT DISTINCT FROM y.lang AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.75 * (na.n + nb.n - c)""")
def f12(spark, d):
    return P.near_duplicate_pairs(table(spark, d, "documents"), "lang")


@query("f12_near_duplicate_members", """WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents), s AS (
    SELECT DISTINCT doc_id, lang, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), k AS (SELECT doc_id, lang, list(g ORDER BY g) AS gs FROM s GROUP BY ALL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, gs) AS class_id FROM k UNION ALL SELECT doc_id, doc_id FROM w WHERE coalesce(len(w), 0) = 0""")
def f12_members(spark, d):
    """Whom the documents of f12's pairs stand for: a row per document."""
    return P.near_duplicate_members(table(spark, d, "documents"), "lang")


@query("f15_option_candidates", f"""WITH {B.RECORDS_SQL}, o AS (SELECT DISTINCT p_name AS key, (p_size % 4)::VARCHAR AS option FROM part) SELECT id, key, option, list_contains(string_split(value, '/'), option) AS chosen, count(*) AS n FROM records JOIN o USING (key) GROUP BY ALL""")
def f15(spark, d):
    o = table(spark, d, "part").select(F.col("p_name").alias("key"), (F.col("p_size") % 4).cast("string").alias("option")).distinct()
    return P.option_candidates(B.records(spark, d), o).groupBy("id", "key", "option", "chosen").agg(F.count("*").alias("n"))


@query("f19_decided_aliases", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, known AS (SELECT title, key AS alias FROM keys WHERE ord % 2 = 0), dec AS (SELECT DISTINCT p_name AS alias, upper(p_name) AS canon FROM part WHERE p_name < 'm')
SELECT DISTINCT r.title, coalesce(canon, r.key) AS canon, r.key AS alias, s % 5 AS source FROM records r LEFT JOIN dec ON dec.alias = r.key WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.title = r.title AND k.alias = r.key)""")
def f19(spark, d):
    evidence = B.records(spark, d).select("title", F.col("key").alias("alias"), (F.col("s") % 5).alias("source"))
    decisions = table(spark, d, "part").filter("p_name < 'm'").select(F.col("p_name").alias("alias"), F.upper("p_name").alias("canon")).distinct()
    return P.decided_aliases(evidence, B.keys(spark, d).filter("ord % 2 = 0"), decisions)


@query("f20_filled_aliases", f"""WITH {B.KEYS_SQL}, a AS (SELECT title, key, CASE WHEN ord % 4 = 0 THEN NULL ELSE alias END AS alias FROM aliases), f AS (SELECT key, min(alias) AS other FROM a GROUP BY key)
SELECT title, key, coalesce(alias, other, key) AS alias, CASE WHEN alias IS NOT NULL THEN 'kept' WHEN other IS NOT NULL THEN 'filled' ELSE 'key' END AS action, count(*) AS n FROM a LEFT JOIN f USING (key) GROUP BY ALL""")
def f20(spark, d):
    a = B.aliases(spark, d).select("title", "key", F.when(F.col("ord") % 4 != 0, F.col("alias")).alias("alias"))
    f = a.groupBy("key").agg(F.min("alias").alias("other"))
    action = F.when(F.col("alias").isNotNull(), "kept").when(F.col("other").isNotNull(), "filled").otherwise("key")
    return a.join(f, "key", "left").groupBy("title", "key", F.coalesce("alias", "other", "key").alias("alias"), action.alias("action")).agg(F.count("*").alias("n"))


@query("g23_window_grid", r"""WITH t AS (SELECT len(regexp_extract_all(text, '[^ \t\n]+[ \t\n]*')) AS n FROM documents), g(size, overlap) AS (VALUES (32, 0), (32, 8), (64, 16), (128, 32))
SELECT size, overlap, sum(CASE WHEN n <= size THEN 1 ELSE ceil((n - overlap) / (size - overlap)) END)::BIGINT AS windows FROM t, g GROUP BY ALL""")
def g23(spark, d):
    docs, out = table(spark, d, "documents").select("doc_id", "text"), None
    for size, overlap in ((32, 0), (32, 8), (64, 16), (128, 32)):
        one = H.token_windows(docs, size, overlap).agg(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.count("*").alias("windows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g24_unknown_tokens", """WITH v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents WHERE lang = 'en'), t AS (SELECT item_id AS doc_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM t)
SELECT doc_id, pos::INT AS pos, w[pos + 1] AS token, array_to_string(w[greatest(pos - 2, 0) + 1:pos + 3], ' ') AS around FROM p WHERE w[pos + 1] NOT IN (SELECT token FROM v)""")
def g24(spark, d):
    v = table(spark, d, "documents").filter("lang = 'en'").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return P.unknown_tokens(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), v, 2)


PLACE = "('0x' || substr(md5('2:' || key), 1, 8))::BIGINT / 4294967296.0"


@query("h9_key_rounds", f"WITH {B.KEYS_SQL} SELECT title, key, least(4, greatest(0, ceil(({PLACE} - 0.3) / 0.2)))::INT AS round FROM keys")
def h9(spark, d):
    return P.key_rounds(B.keys(spark, d).select("title", "key"), "key", 0.3, 0.2, 4, 2)


@query("g25_round_statistics", f"WITH {B.KEYS_SQL}, r AS (SELECT title, key, least(4, greatest(0, ceil(({PLACE} - 0.3) / 0.2)))::INT AS round FROM keys) SELECT round, count(DISTINCT key) AS keys, count(DISTINCT title) AS titles FROM r GROUP BY round")
def g25(spark, d):
    return h9(spark, d).groupBy("round").agg(F.count_distinct("key").alias("keys"), F.count_distinct("title").alias("titles"))


@query("h5_minority_titles", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT list_sort(list(n))[1 + len(list(n)) // 2] AS target FROM c) SELECT source, n, ceil((target - n) / n)::BIGINT AS attempts FROM c, t WHERE n <= target")
def h5(spark, d):
    c = C.title_counts(table(spark, d, "documents"), "source")
    return c.crossJoin(C.upper_median(c)).filter("n <= target").select("source", "n", F.ceil((F.col("target") - F.col("n")) / F.col("n")).alias("attempts"))


@query("h13_drop_frequent", f"""WITH {B.RECORDS_SQL}, one AS (SELECT id, title, key, min(s) % 2 = 0 AS has_alias FROM records GROUP BY ALL), c AS (SELECT title, key, count(*) AS n FROM one GROUP BY ALL), th AS (SELECT title, list_sort(list(n))[ceil(0.7 * len(list(n)))::INT] AS threshold FROM c GROUP BY title
), r AS (SELECT one.*, n, n >= threshold AS f FROM one JOIN c USING (title, key) JOIN th USING (title)), k AS (SELECT *, row_number() OVER (PARTITION BY id, f ORDER BY has_alias::INT, md5('9:' || id || ':' || key), key, title) AS rn, count(*) OVER (PARTITION BY id, f) AS k FROM r)
SELECT id, title, key FROM k WHERE NOT (f AND rn <= ceil(k * 0.5))""")
def h13(spark, d):
    one = B.records(spark, d).groupBy("id", "title", "key").agg((F.min("s") % 2 == 0).alias("has_alias"))
    counts = one.groupBy("title", "key").agg(F.count("*").alias("n"))
    return P.drop_frequent(one.join(counts, ["title", "key"]), C.frequency_threshold(counts, "title", 0.7), 0.5, 9).select("id", "title", "key")


@query("h14_key_jitter", f"""WITH {B.RECORDS_SQL}, one AS (SELECT DISTINCT id, key FROM records), r AS (SELECT *, ('0x' || substr(md5('4:' || id || ':' || key), 1, 8))::BIGINT % 10000 AS luck FROM one)
SELECT id, key FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY luck DESC, key) AS rn FROM r) WHERE luck >= 4000 OR rn <= 2""")
def h14(spark, d):
    return P.jitter(B.records(spark, d).select("id", "key").distinct(), 0.4, 2, 4)


@query("h17_evaluation_subset", f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, {q(TOKEN)})) < 400 ORDER BY md5('6:' || doc_id), doc_id LIMIT 100")
def h17(spark, d):
    rows = table(spark, d, "documents").filter(T.token_count(F.col("text")) < 400)
    return rows.orderBy(C.chance(6, F.col("doc_id")), "doc_id").limit(100).select("doc_id")


@query("h18_reports", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, r AS (SELECT id, title, key, min(ord) AS own, min_by(value, ord) AS value FROM records GROUP BY ALL), k AS (SELECT r.*, row_number() OVER (PARTITION BY id, title ORDER BY coalesce(keys.ord, 1099511627776 + own), key) AS rn FROM r LEFT JOIN keys USING (title, key))
SELECT id, title, title || chr(10) || string_agg(key || ['：', ': ', ' '][(rn - 1) % 3 + 1] || value, chr(10) ORDER BY rn) AS report FROM k GROUP BY id, title""")
def h18(spark, d):
    return P.reports(B.records(spark, d), B.keys(spark, d), ["：", ": ", " "])


@query("h20_wanted_keys", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, own AS (SELECT id, title, list(key ORDER BY ord) AS own FROM records GROUP BY ALL), std AS (SELECT title, list(key ORDER BY ord) AS std FROM keys WHERE ord % 2 = 0 GROUP BY title)
SELECT id, title, len(list_distinct(list_concat(coalesce(std, []), own)))::INT AS n FROM own LEFT JOIN std USING (title)""")
def h20(spark, d):
    return P.wanted_keys(B.records(spark, d), B.keys(spark, d).filter("ord % 2 = 0")).select("id", "title", F.size("keys").alias("n"))


@query("j1_scored", f"WITH {B.RECORDS_SQL} SELECT id, ord, key, CASE WHEN length(key) % 5 = 0 THEN NULL ELSE upper(key) END AS result, length(key) % 5 = 0 AS failed FROM records")
def j1(spark, d):
    def decide(value: str) -> str:
        if len(value) % 5 == 0:
            raise ValueError("no decision")
        return value.upper()

    return P.scored(B.records(spark, d).select("id", "ord", "key"), "key", decide).select("id", "ord", "key", "result", F.col("error").isNotNull().alias("failed"))


@query("a9_split_counts", "WITH r AS (SELECT row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents) SELECT CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY ALL")
def a9(spark, d):
    return C.ratio_split(table(spark, d, "documents"), "doc_id", [("train", 0.8), ("val", 0.1), ("test", 0.1)], 3).groupBy("split").agg(F.count("*").alias("n"))


@query("a12_review_tables", f"WITH {B.RECORDS_SQL} SELECT id, '<table>' || string_agg('<tr><td>' || key || '</td><td>' || value || '</td></tr>', '' ORDER BY ord) || '</table>' AS \"table\" FROM records GROUP BY id")
def a12(spark, d):
    return io.review_tasks(B.records(spark, d).select("id", "key", "value", "ord")).select("id", "table")


@query("b22_locators", "SELECT event_id, list_sort(list_filter(json_keys(props), lambda k: contains(k, 'e')))::VARCHAR AS keys FROM events")
def b22(spark, d):
    m = F.from_json("props", "map<string,string>")
    kept = F.array_sort(F.map_keys(F.map_filter(m, lambda k, _: F.contains(k, F.lit("e")))))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("keys"))
