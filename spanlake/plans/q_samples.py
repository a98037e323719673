"""Queries of question samples, dynamic spans and layout breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import samples as Q
from ..operators import spans as S
from ..sources import io
from . import bindings as B
from .q_keys import BUCKET
from .q_spans import LOGITS_SQL, logits
from .q_text import TOKEN, q
from .registry import query, table

ASKED = {"the": "Where is the word?", "tail": "What does the text end with?", "none": "Is it missing?"}


def questions(spark, d):
    """Three questions of each document: for its first `` the ``, its last 40 characters, and one that nothing answers."""
    docs = table(spark, d, "documents").filter("text <> ''")
    at, n = F.instr("text", " the ") - 1, F.length("text")
    one = lambda key, start, end, present: F.struct(F.lit(key).alias("key"), F.lit(ASKED[key]).alias("question"), start.alias("start"), end.alias("end"), present.alias("present"))
    rows = F.array(one("the", at, at + 5, at >= 0), one("tail", F.greatest(n - 40, F.lit(0)), n, F.lit(True)), one("none", F.lit(-1), F.lit(-1), F.lit(False)))
    return docs.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


@query("e6_question_samples", f"""WITH t AS (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text[1:length(text) - 1], chr(10)) ELSE string_split(text, chr(10)) END AS p FROM documents WHERE text <> ''
), r AS (SELECT doc_id, text, len(p) AS n, list_transform(p, lambda x: length(x)) AS ln, list_transform(p, lambda x: len(regexp_extract_all(x, {q(TOKEN)}))) AS tk FROM t
), o AS (SELECT doc_id, text, n, ln, tk, list_transform(range(1, n + 1), lambda i: (coalesce(list_sum(ln[1:i - 1]), 0) + i - 1)::INT) AS st FROM r
), a AS (SELECT doc_id, 'the' AS key, {q(ASKED["the"])} AS question, strpos(text, ' the ') - 1 AS a, strpos(text, ' the ') + 4 AS b, contains(text, ' the ') AS present FROM t
    UNION ALL SELECT doc_id, 'tail', {q(ASKED["tail"])}, greatest(length(text) - 40, 0), length(text), TRUE FROM t UNION ALL SELECT doc_id, 'none', {q(ASKED["none"])}, -1, -1, FALSE FROM t
), f AS (SELECT *, a >= 0 AND b > a AS found, greatest(1, least(120, 130 - len(regexp_extract_all(question, {q(TOKEN)})) - 3)) AS budget, a + length(text[a + 1:b]) - length(ltrim(text[a + 1:b], ' ' || chr(9) || chr(10) || chr(13))) AS s,
    rtrim(rtrim(ltrim(text[a + 1:b], ' ' || chr(9) || chr(10) || chr(13)), ' ' || chr(9) || chr(10) || chr(13)), '，。,；;、:：)]）】>》') AS v FROM a JOIN o USING (doc_id)
), g AS (SELECT *, least(5, greatest(3, n // 4)) AS w, greatest(1, least(5, greatest(3, n // 4)) // 2) AS step FROM f
), c AS (SELECT *, CASE WHEN found THEN [{{'x': coalesce(list_filter(range(n), lambda i: st[i + 1] <= a AND a < st[i + 1] + ln[i + 1])[1], 0), 'y': least(coalesce(list_filter(range(n), lambda i: st[i + 1] < b AND b <= st[i + 1] + ln[i + 1])[1], n - 1) + 1, n - 1)}}]
    WHEN n > 3 THEN list_transform(range(greatest(0, ceil((n - w) / step))::INT + 1), lambda i: {{'x': i * step, 'y': least(i * step + w, n) - 1}}) ELSE [{{'x': 0, 'y': n - 1}}] END AS cs FROM g
), k AS (SELECT *, flatten(list_transform(cs, lambda z: CASE WHEN list_sum(tk[z.x + 1:z.y + 1]) > budget AND z.y > z.x THEN list_transform(list_filter(range(z.x, z.y + 1), lambda i: ln[i + 1] > 0), lambda i: {{'cs': st[i + 1], 'ce': (st[i + 1] + ln[i + 1])::INT}})
    WHEN NOT found AND n <= 3 THEN [{{'cs': 0, 'ce': length(text)::INT}}] ELSE [{{'cs': st[z.x + 1], 'ce': (st[z.y + 1] + ln[z.y + 1])::INT}}] END)) AS ks FROM c
), e AS (SELECT doc_id, key, present, found, s, s + length(v) AS e, unnest(range(len(ks))) AS chunk, unnest(ks) AS z FROM k)
SELECT doc_id, key, chunk::INT AS chunk, CASE WHEN found AND e > s THEN 'positive' ELSE 'negative' END AS kind, z.cs AS char_start, z.ce AS char_end, (CASE WHEN found AND e > s THEN s - z.cs ELSE -1 END)::INT AS answer_start, (CASE WHEN found AND e > s THEN e - z.cs ELSE -1 END)::INT AS answer_end
FROM e WHERE (NOT found OR (s >= z.cs AND e <= z.ce)) AND ((found AND e > s) OR {BUCKET.format("doc_id || '/' || key || '/' || chunk")} < CASE WHEN present THEN 5000 ELSE 1000 END)""")
def e6(spark, d):
    return Q.question_samples(table(spark, d, "documents"), questions(spark, d), 120, 130, 0.5, "\n")


@query("c11_dynamic_spans", f"""WITH {LOGITS_SQL}, l AS (SELECT *, idx // 8 AS c8, doc % 3 = 0 AS short FROM logits), r AS (SELECT *, row_number() OVER (PARTITION BY doc, c8 ORDER BY sl DESC, idx) AS rs, row_number() OVER (PARTITION BY doc, c8 ORDER BY el DESC, idx) AS re FROM l
), t AS (SELECT a.doc, a.c8, a.idx, a.sl, a.rs, a.short, b.idx AS j, exp((b.el - max(b.el) OVER w)::DOUBLE) AS x FROM r a JOIN r b ON a.doc = b.doc AND a.c8 = b.c8 AND b.idx >= a.idx WHERE a.rs <= 4 WINDOW w AS (PARTITION BY a.doc, a.c8, a.idx)
), u AS (SELECT *, coalesce(sum(x) OVER (PARTITION BY doc, c8, idx ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(x) OVER (PARTITION BY doc, c8, idx) AS before FROM t
), k AS (SELECT doc, c8, idx, sl, rs, short, greatest(1, least(count(*) FILTER (before < 0.9), 5, CASE WHEN short THEN 2 ELSE 5 END)) AS cap FROM u GROUP BY doc, c8, idx, sl, rs, short
), p AS (SELECT k.doc, k.c8, k.idx AS a, e.idx AS b, k.sl + e.el + CASE WHEN k.short THEN 0.2 * (8 - (e.idx - k.idx + 1)) / 8 ELSE 0 END AS score, e.re <= 4 AS good, k.rs, e.el FROM k JOIN r e ON k.doc = e.doc AND k.c8 = e.c8 AND e.idx >= k.idx AND e.idx < k.idx + k.cap
), z AS (SELECT *, row_number() OVER (PARTITION BY doc, c8 ORDER BY good DESC, CASE WHEN good THEN -score ELSE rs END, CASE WHEN good THEN a ELSE -el END, b) AS rn FROM p)
SELECT doc, c8 AS chunk, a AS "start", b AS "end", round(score, 6) AS score FROM z WHERE rn = 1""")
def c11_dynamic(spark, d):
    x = logits(spark, d).withColumn("chunk", F.floor(F.col("idx") / 8)).withColumn("is_short", F.col("doc") % 3 == 0)
    return S.dynamic_spans(x, top=4, longest=5, short_cap=2).withColumn("score", F.round("score", 6))


LINES_SQL = """raw AS (SELECT page_id AS doc, string_split(html, '<') AS p FROM pages), lines AS (SELECT doc, i - 1 AS line, replace(p[i], '>', '。') AS words, (((i - 1) * 7) % 40)::DOUBLE AS l, (((i - 1) * 7) % 40 + 3 * least(length(p[i]), 60))::DOUBLE AS r FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS i FROM raw))"""


def lines(spark, d):
    """A page's markup as scanned lines: pieces between tags, with boxes by place and length."""
    box = lambda i, x: F.struct(((i * 7) % 40).cast("int").alias("left"), (i * 20).cast("int").alias("top"), (3 * F.least(F.length(x), F.lit(60))).cast("int").alias("width"), F.lit(18).alias("height"))
    words = F.transform(F.split("html", "<"), lambda x, i: F.struct(F.replace(x, F.lit(">"), F.lit("。")).alias("words"), box(i, x).alias("location"), F.lit(1.0).alias("probability")))
    return io.ocr_lines(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page"), words.alias("words_result")))


def with_ids(spark, d):
    return lines(spark, d).select(F.col("page").cast("long").alias("doc"), "line", "words", F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))


@query("a7_ocr_lines", f"WITH {LINES_SQL} SELECT doc, line::INT AS line, md5(words) AS digest, l::INT AS l, r::INT AS r FROM lines")
def a7_lines(spark, d):
    return lines(spark, d).select(F.col("page").cast("long").alias("doc"), "line", F.md5("words").alias("digest"), F.col("left").alias("l"), F.col("right").alias("r"))


@query("e12_break_places", f"""WITH {LINES_SQL}, w AS (SELECT *, len(regexp_extract_all(words, {q(TOKEN)})) AS tokens, trim(words, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS inked FROM lines
), x AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, sum(tokens) OVER (PARTITION BY doc) AS total, sum(tokens) OVER (PARTITION BY doc ORDER BY line) AS run, coalesce(min(l) FILTER (inked) OVER (PARTITION BY doc), 0) AS low, coalesce(max(r) FILTER (inked) OVER (PARTITION BY doc), 0) AS high, lead(words) OVER (PARTITION BY doc ORDER BY line) AS nw, lead(l) OVER (PARTITION BY doc ORDER BY line) AS nl FROM w
), y AS (SELECT *, least(min(line) FILTER (run >= 150) OVER (PARTITION BY doc), n - 2) AS near, rtrim(words, ' ' || chr(9) || chr(10) || chr(13)) LIKE '%。' AS period FROM x WHERE total > 150 AND n > 1
), z AS (SELECT *, words || nw <> '' AND (greatest(0, high - r) > greatest(0.2 * greatest(1, high - low), 12) OR (period AND (greatest(0, nl - low) <= greatest(0.12 * greatest(1, high - low), 8) OR NOT regexp_matches(nw, '^[ \\t\\n\\r]*([0-9]+|[一二三四五六七八九十百千]+|[ivxlcdmIVXLCDM]+)')))) AS nat FROM y WHERE line < n - 1
), v AS (SELECT *, CASE WHEN nat AND line >= near THEN 0 WHEN nat THEN 1 WHEN period AND line >= near THEN 2 WHEN period THEN 3 WHEN line = near THEN 4 END AS k FROM z)
SELECT doc, arg_min(line, k * 1000000 + abs(line - near))::INT AS "at" FROM v WHERE k IS NOT NULL GROUP BY doc""")
def e12_places(spark, d):
    return L.break_places(with_ids(spark, d), 150)


@query("e12_layout_breaks")
def e12(spark, d):
    out = L.layout_breaks(with_ids(spark, d), 150)
    return out.select("doc", F.instr("text", "\n\n").alias("broken_at"), T.token_count(F.col("text")).alias("tokens"), F.md5("text").alias("digest"))
