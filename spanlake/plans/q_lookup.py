"""Queries of full normal forms, ladders, line helpers, alias filling and similarity with a lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import aliasfill as A
from ..operators import curate as C
from ..operators import ladder as L
from ..operators import layout as Y
from ..operators.context import scorer_contexts
from . import bindings as B
from .q_text import q
from .registry import query, table

MIXED = "ﬁ①㎎½Å：ＡＢ"


@query("b2_full_key", f"SELECT doc_id, rtrim(source || 'fi1mg1⁄2Å:AB' || lang || substr('：，。', 1, (doc_id % 4)::INT), {q(T.KEY_TAIL)}) AS x FROM documents")
def b2_full(spark, d):
    raw = F.concat("source", F.lit(f" {MIXED}　"), "lang", F.substr(F.lit("：，。"), F.lit(1), (F.col("doc_id") % 4).cast("int")))
    return table(spark, d, "documents").select("doc_id", U.full_key(raw).alias("x"))


@query("b3_full_value", f"SELECT doc_id, trim(trim(source || ' fi1mg1⁄2Å:AB-' || lang, {q(T.SPACES)}), {q(T.VALUE_EDGE)}) AS x FROM documents")
def b3_full(spark, d):
    return table(spark, d, "documents").select("doc_id", U.full_value(F.concat(F.lit("　（"), "source", F.lit(f" {MIXED}—"), "lang", F.lit("；"))).alias("x"))


@query("e10_ladder_chunks")
def e10_ladder(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit("。")).alias("text"))
    return L.ladder_chunks(docs).select("doc_id", "chunk", F.length("body").alias("n"), F.md5("raw").alias("digest"))


@query("b24_line_helpers", r"""WITH w AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)), p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM w)
SELECT doc_id, count(*) FILTER (a <> '' AND b <> '' AND NOT contains('([{（【"''“‘', right(a, 1)) AND NOT contains(')]}）】"''”’.,，。!！?？:：;；、', left(b, 1)) AND right(a, 1) <> chr(9) AND left(b, 1) <> chr(9)) AS spaces,
    count(*) FILTER (regexp_matches(b, '^[ \t\n\r]*([0-9]+|[一二三四五六七八九十百千]+|[ivxlcdmIVXLCDM]+)')) AS numbered FROM p GROUP BY doc_id""")
def b24_lines(spark, d):
    w = F.split("text", " ")
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))).alias("p")).select("doc_id", "p.*")
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return rows.groupBy("doc_id").agg(one(Y.needs_space(F.col("a"), F.col("b"))).alias("spaces"), one(Y.starts_numbered(F.col("b"))).alias("numbered"))


REMAP_SQL = f"""{B.KEYS_SQL}, a AS (SELECT ord % 50 AS id, title, CASE WHEN ord % 3 = 1 THEN 'x' || key ELSE key END AS key, alias, ord FROM aliases
), dec AS (SELECT title, alias AS data_key, min(key) AS mapped FROM aliases WHERE length(alias) % 2 = 0 GROUP BY ALL
), r AS (SELECT a.id, a.title, a.key, a.alias, a.ord, coalesce(k.key, dec.mapped) AS canon, CASE WHEN k.key IS NOT NULL THEN 'kept' WHEN dec.mapped IS NOT NULL THEN 'alias_key_remap' ELSE 'alias_key_remap_failed' END AS task FROM a LEFT JOIN keys k ON a.title = k.title AND a.key = k.key LEFT JOIN dec ON dec.title = a.title AND dec.data_key = a.alias
), m AS (SELECT *, canon IS NOT NULL AND row_number() OVER (PARTITION BY id, title, canon ORDER BY ord, key) = 1 AS taken FROM r)"""


def remapped(spark, d):
    a = B.aliases(spark, d)
    said = a.filter(F.length("alias") % 2 == 0).groupBy("title", F.col("alias").alias("data_key")).agg(F.min("key").alias("mapped")).withColumns({"confidence": F.lit(0.5), "reason": F.lit("by type")})
    rows = a.select((F.col("ord") % 50).alias("id"), "title", F.when(F.col("ord") % 3 == 1, F.concat(F.lit("x"), "key")).otherwise(F.col("key")).alias("key"), "alias", "ord")
    return A.remapped_aliases(rows, B.keys(spark, d), said)


@query("f20_remapped", f"WITH {REMAP_SQL} SELECT id, title, key, alias, ord, task, canon, CASE WHEN task = 'alias_key_remap' THEN 0.5::DOUBLE END AS confidence, CASE WHEN task = 'alias_key_remap' THEN 'by type' END AS reason, taken FROM m")
def f20_remapped(spark, d):
    return remapped(spark, d)


@query("f20_filled_map", f"""WITH {REMAP_SQL}, {B.RECORDS_SQL}, rec AS (SELECT id % 50 AS id, title, key, max(value) AS value FROM records WHERE s % 3 <> 0 GROUP BY id % 50, title, key
), ids AS (SELECT DISTINCT id, title FROM rec), f AS (SELECT DISTINCT key, value, 'al' || length(key) AS alias FROM rec WHERE length(value) % 2 = 0
), x AS (SELECT ids.id, ids.title, keys.key, rec.value, rec.key IS NOT NULL AS there, CASE WHEN m.alias IS NULL OR length(m.alias) % 3 = 0 THEN '' ELSE m.alias END AS old, f.alias AS new FROM ids JOIN keys USING (title) LEFT JOIN rec ON rec.id = ids.id AND rec.title = ids.title AND rec.key = keys.key LEFT JOIN m ON m.taken AND m.id = ids.id AND m.title = ids.title AND m.canon = keys.key LEFT JOIN f ON f.key = rec.key AND f.value = rec.value
), y AS (SELECT *, CASE WHEN there AND old <> '' THEN old WHEN there AND new IS NOT NULL THEN new ELSE '' END AS alias, CASE WHEN there AND old <> '' THEN NULL ELSE 'fill_missing' END AS task, there AND old = '' AND new IS NOT NULL AS found FROM x)
SELECT title, alias, task, found, count(*) AS n, count(value) AS values FROM y GROUP BY ALL""".replace("AS values", "AS with_value"))
def f20_filled(spark, d):
    rec = B.records(spark, d).filter("s % 3 <> 0").groupBy((F.col("id") % 50).alias("id"), "title", "key").agg(F.max("value").alias("value"))
    taken = remapped(spark, d).filter("taken").select("id", "title", F.col("canon").alias("key"), F.when(F.length("alias") % 3 != 0, F.col("alias")).alias("alias"))
    found = rec.filter(F.length("value") % 2 == 0).select("key", "value", F.concat(F.lit("al"), F.length("key").cast("string")).alias("alias")).distinct()
    none = spark.createDataFrame([], "id long, report string"), spark.createDataFrame([], "title string, data_key string, mapped string")
    out = A.filled_aliases(taken, B.keys(spark, d), rec, *none, found)
    return out.groupBy("title", "alias", "task", "found").agg(F.count("*").alias("n"), F.count("value").alias("with_value"))


@query("j2_lexicon", """WITH l AS (SELECT p_brand AS a, p_type AS b, max(p_size / 100.0) AS score FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL), k AS (SELECT p_type AS a, p_brand AS b, max(p_size / 50.0) AS score FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL)
SELECT p_partkey, round(coalesce(k.score, l.score, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6)::DOUBLE AS score FROM (SELECT p_partkey, p_type, p_brand, list_distinct(string_split(p_type, '')) AS x, list_distinct(string_split(p_brand, '')) AS y FROM part) LEFT JOIN k ON k.a = p_type AND k.b = p_brand LEFT JOIN l ON l.a = p_brand AND l.b = p_type""")
def j2_lexicon(spark, d):
    p = table(spark, d, "part")
    entry = lambda a, b, n, by: p.filter(F.col("p_partkey") % n == 0).select(F.col(a).alias("a"), F.col(b).alias("b"), (F.col("p_size") / by).alias("score"))
    lexicon = entry("p_brand", "p_type", 5, 100).unionByName(entry("p_type", "p_brand", 7, 50))
    return A.lexicon_similarity(p.select("p_partkey", F.col("p_type").alias("a"), F.col("p_brand").alias("b")), lexicon).select("p_partkey", F.round("score", 6).alias("score"))


@query("j3_contexts")
def j3_contexts(spark, d):
    """Fields of orders with their neighbours, and the texts of the vectors most like the order's own as examples."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vec_id")).distinct()
    best = C.top_similar(e, e.join(orders, "vec_id", "left_semi"), 3).filter("score is not null")
    # As they are shown; whole texts needn't move.
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), C.shown_examples(F.array("text"))[0].alias("text"))
    hits = best.join(texts, "vec_id").select(F.col("query_id").alias("id"), "rank", "text")
    out = scorer_contexts(B.records(spark, d), B.keys(spark, d), B.aliases(spark, d), hits)
    return out.select("id", "title", "key", F.md5("query").alias("query"), F.md5("around").alias("around"), F.md5(F.array_join("examples", "|")).alias("examples"), F.size("examples").alias("n"))
