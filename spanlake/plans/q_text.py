"""Queries of the text functions, over whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import mask as K
from ..functions import text as T
from . import bindings as B
from .registry import query, table


def q(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


SPACE, FULL, HALF = q(T.SPACE_CLASS), q(T.FULL_WIDTH), q(T.HALF_WIDTH)
TEXT_SQL = "SELECT doc_id, '（' || source || '） ' || lang || '： ' || text || ' 。' AS x FROM documents"


def decorated(spark, d):
    """Whole texts between full-width marks, so that edges have something to strip."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("（"), "source", F.lit("） "), "lang", F.lit("： "), "text", F.lit(" 。")).alias("x"))


def scalar(name: str, make: Callable[[Column], Column], sql: str) -> None:
    """A query that gives length and md5 of a function of each whole text."""

    @query(name, f"SELECT doc_id, length(y)::BIGINT AS n, md5(y) AS digest FROM (SELECT doc_id, {sql} AS y FROM ({TEXT_SQL}))")
    def run(spark, d):
        rows = decorated(spark, d).select("doc_id", make(F.col("x")).alias("y"))
        return rows.select("doc_id", F.length("y").cast("long").alias("n"), F.md5("y").alias("digest"))


FOLD = f"translate(x, {FULL}, {HALF})"
scalar("b1_canonical_key", T.canonical_key, f"regexp_replace(translate(x, '：（）', ':()'), {SPACE}, '', 'g')")
scalar("b2_normal_key", T.normal_key, f"rtrim(regexp_replace({FOLD}, {SPACE}, '', 'g'), {q(T.KEY_TAIL)})")
scalar("b3_normal_value", T.normal_value, f"trim(trim(translate({FOLD}, '—–', '--'), {q(T.SPACES)}), {q(T.VALUE_EDGE)})")
scalar("b5_strip_limited", lambda c: T.strip_limited(c, 3), f"""(SELECT substr(r, 1, length(r) - least(length(regexp_extract(r, {q(T.EDGE_CLASS + "*$")})), 3 - l)::BIGINT) FROM (SELECT length(regexp_extract(x, {q("^" + T.EDGE_CLASS + "{0,3}")})) AS l, substr(x, l + 1) AS r))""")
scalar("b8_report_text", T.report_text, f"CASE WHEN trim(x, {q(T.SPACES)}) = '' THEN '' ELSE translate(regexp_replace(x, {q(chr(13) + chr(10) + '?')}, {q(chr(10))}, 'g'), {q(chr(0xA0) + '　:')}, '  ：') END")
scalar("b9_one_line", T.one_line, f"trim(regexp_replace(x, {q(T.SPACE_CLASS + '+')}, ' ', 'g'), ' ')")
TIDY = f"regexp_replace(x, {q(T.SPACE_CLASS + '+([。；，,、！？:：])')}, '\\1', 'g')"
for _mark in "。！？；，,:：":
    TIDY = f"regexp_replace({TIDY}, '{_mark}{{2,}}', '{_mark}', 'g')"
scalar("b9_tidy", T.tidy, TIDY)
scalar("b10_fingerprint", T.fingerprint, f"md5(lower(regexp_replace(x, {q(T.SPACE_CLASS + '+')}, '', 'g')))")
scalar("b14d_mask_id", K.mask_id, f"regexp_replace(x, {q(K.ID)}, '\\1{'*' * 8}\\2', 'g')")
scalar("b14e_mask_phone", K.mask_phone, f"regexp_replace(x, {q(K.PHONE)}, '\\1****\\2', 'g')")
scalar("b14g_mask_address", K.mask_address, f"regexp_replace(x, {q(K.ADDRESS)}, '\\1：*', 'g')")


def edges(name: str, make, chars: str, keep: bool) -> None:
    text = "CASE WHEN t = '' THEN x ELSE t END" if keep else "t"

    @query(
        name,
        f"""
SELECT doc_id, md5({text}) AS digest, (length(x) - length(l))::BIGINT AS "start", (length(x) - (length(l) - length(t)))::BIGINT AS "end"
FROM (SELECT *, ltrim(x, {q(chars)}) AS l, rtrim(ltrim(x, {q(chars)}), {q(chars)}) AS t FROM ({TEXT_SQL}))""",
    )
    def run(spark, d):
        s = make(F.col("x"), F.lit(0), F.length("x"))
        return decorated(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.md5("s.text").alias("digest"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


edges("b4_strip_punctuation", T.strip_punctuation, T.PUNCTUATION, True)
edges("b6_strip_noise", T.strip_noise, T.NOISE, False)
edges("b7_tighten", T.tighten, T.SPACES, False)

TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+|[^\p{L}\p{N}_ \t\n\r\x0b\x0c\x{a0}\x{3000}]"


@query("b13_token_count", f"SELECT doc_id, len(regexp_extract_all(x, {q(TOKEN)}))::BIGINT AS n FROM ({TEXT_SQL})")
def b13(spark, d):
    return decorated(spark, d).select("doc_id", T.token_count(F.col("x")).cast("long").alias("n"))


@query("b11_missing", f"SELECT value, upper(trim(value, {q(T.SPACES)})) IN ({', '.join(map(q, T.MISSING))}) AS missing FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN ' n/a ' WHEN p_size % 11 = 0 THEN '未知' ELSE p_name END AS value FROM part)")
def b11(spark, d):
    value = F.when(F.col("p_size") % 7 == 0, " n/a ").when(F.col("p_size") % 11 == 0, "未知").otherwise(F.col("p_name"))
    return table(spark, d, "part").select(value.alias("value")).distinct().select("value", T.is_missing(F.col("value")).alias("missing"))


@query("b17_valid_span", f"""WITH {B.GOLD_SQL} SELECT doc, "start" - 350 >= 0 AND "end" - 350 > "start" - 350 AND trim(text, {q(T.SPACES)}) <> '' AS valid, count(*) AS n FROM gold GROUP BY ALL""")
def b17(spark, d):
    ok = T.is_valid_span(F.col("start") - 350, F.col("end") - 350, F.col("text"))
    return B.gold(spark, d).groupBy("doc", ok.alias("valid")).agg(F.count("*").alias("n"))


SHORT = f"length(v) <= 8 OR len(regexp_extract_all(v, {q(TOKEN)})) <= 6 OR regexp_matches(v, '^[0-9\\-/ \\t\\n]{{1,15}}$') OR regexp_matches(v, '^[a-zA-Z \\t\\n]{{1,10}}$') OR regexp_matches(v, '^[\\x{{4e00}}-\\x{{9fff}}]{{1,5}}$')"


@query("b18_short_field", f"SELECT conv_id, turn, {SHORT} AS short FROM (SELECT conv_id, turn, trim(text, {q(T.SPACES)}) AS v FROM conversations)")
def b18(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_short(F.col("text")).alias("short"))


HEAD = r"(?s)^(.{6}[^。；;，,\n]*)[。；;，,\n]"


@query("b19_shorten_value", f"SELECT conv_id, turn, CASE WHEN length(text) > 64 AND h <> '' THEN trim(h, {q(T.SPACES)}) ELSE text END AS text, CASE WHEN length(text) > 64 AND h <> '' THEN length(h) ELSE length(text) END::BIGINT AS \"end\" FROM (SELECT *, regexp_extract(text, {q(HEAD)}, 1) AS h FROM conversations)")
def b19(spark, d):
    s = T.shorten_value(F.col("role"), F.col("text"), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.col("s.text").alias("text"), F.col("s.end").cast("long").alias("end"))


@query("b21_context", """
SELECT item_id, CASE WHEN pos > 0 THEN substr(d.text, greatest(1, pos - 80), least(length(d.text), pos - 1 + length(v) + 80) - greatest(1, pos - 80) + 1) ELSE left(d.text, 320) END AS snippet
FROM (SELECT item_id, split_part(b.text, ' ', 3) AS v, d.text, strpos(d.text, split_part(b.text, ' ', 3)) AS pos FROM benchmark b JOIN documents d ON b.item_id = d.doc_id) d""")
def b21(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ")[2].alias("v")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return rows.select("item_id", T.context(F.col("text"), F.col("v")).alias("snippet"))


@query("b12_clean_alias", f"""
WITH {B.KEYS_SQL}, raw AS (
    SELECT title, key, CASE ord % 5 WHEN 0 THEN ' ' || alias || '：' || key WHEN 1 THEN '标签:' || alias WHEN 2 THEN alias || '为' || ord WHEN 3 THEN ' n/a' ELSE '(' || alias || ')' END AS alias, ord FROM aliases
), t AS (SELECT *, trim(alias, {q(T.SPACES + T.ALIAS_EDGE)}) AS a FROM raw
), c AS (SELECT *, CASE WHEN strpos(a, ':') > 0 THEN strpos(a, ':') ELSE strpos(a, '：') END AS colon FROM t
), lr AS (SELECT *, trim(substr(a, 1, colon - 1), {q(T.SPACES + T.ALIAS_EDGE)}) AS l, trim(substr(a, colon + 1), {q(T.SPACES + T.ALIAS_EDGE)}) AS r FROM c
), s AS (SELECT *, CASE WHEN colon > 0 THEN CASE WHEN regexp_matches(l, '别名|标签|字段|名称|项目') THEN r ELSE l END ELSE a END AS b FROM lr
), v AS (SELECT *, CASE WHEN strpos(b, '为') > 0 THEN strpos(b, '为') ELSE strpos(b, '是') END AS verb FROM s
), f AS (SELECT *, CASE WHEN verb > 0 THEN trim(substr(b, 1, verb - 1), {q(T.SPACES + T.ALIAS_EDGE)}) ELSE b END AS z FROM v)
SELECT title, key, ord, CASE WHEN upper(trim(alias, {q(T.SPACES)})) IN ({', '.join(map(q, T.MISSING))}) OR (z <> '' AND contains(z, 'STEEL')) THEN key ELSE left(z, 50) END AS cleaned FROM f""")
def b12(spark, d):
    a, o = F.col("alias"), F.col("ord")
    raw = (
        F.when(o % 5 == 0, F.concat(F.lit(" "), a, F.lit("："), "key")).when(o % 5 == 1, F.concat(F.lit("标签:"), a))
        .when(o % 5 == 2, F.concat(a, F.lit("为"), o.cast("string"))).when(o % 5 == 3, " n/a").otherwise(F.concat(F.lit("("), a, F.lit(")")))
    )
    return B.aliases(spark, d).select("title", "key", "ord", T.clean_alias(F.col("key"), raw, F.lit("STEEL")).alias("cleaned"))


@query("b20_question", f"""
WITH {B.KEYS_SQL}, listed AS (SELECT title, key, list(alias ORDER BY ord, alias) AS a FROM aliases GROUP BY ALL)
SELECT title, key, '找到文本中的' || key || CASE WHEN len(a) >= 2 THEN ',' || key || '别名有' || a[1] || '、' || a[2] || '等' ELSE ',' || key || '别名有' || a[1] END AS question FROM listed""")
def b20(spark, d):
    listed = B.aliases(spark, d).groupBy("title", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "alias"))), lambda x: x["alias"]).alias("a"))
    return listed.select("title", "key", T.question(F.col("key"), F.col("a"), F.lit(None).cast("string")).alias("question"))


@query("b25_filters", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src0') AND trim(text, ' \t\n') <> ''")
def b25(spark, d):
    rows = table(spark, d, "documents")
    return rows.filter(F.col("lang").isin("en", "fr") & ~F.col("source").isin("src0") & (F.btrim("text", F.lit(" \t\n")) != "")).select("doc_id", "lang")


@query("b24_sentence_end", f"SELECT doc_id, right(rtrim(text, {q(T.SPACES)}), 1) IN ({', '.join(map(q, T.SENTENCE_ENDS))}) AS ends FROM documents")
def b24(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ends_sentence(F.col("text")).alias("ends"))


@query("b15_mask_all")
def b15(spark, d):
    return decorated(spark, d).select("doc_id", F.md5(K.mask_all(F.col("x"))).alias("digest"))
