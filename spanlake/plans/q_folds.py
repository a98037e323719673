"""Queries of folds, streams and the remaining assembly forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import fold as D
from ..sources import sinks
from ..streaming import lines
from . import bindings as B
from .q_text import TOKEN, q
from .registry import packed_sql, query, table


@query("e13_corpus_chunks", f"""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents), c AS (SELECT doc_id, {packed_sql("p", "length(i)", 500)} AS c FROM p WHERE len(p) > 0), u AS (SELECT doc_id, unnest(range(len(c)))::INT AS chunk, unnest(c) AS c FROM c)
SELECT doc_id, chunk, length(array_to_string(c.x, chr(10)))::INT AS n, md5(array_to_string(c.x, chr(10))) AS digest FROM u""")
def e13(spark, d):
    out = D.corpus_chunks(table(spark, d, "documents").select("doc_id", "text"), "\n", 500)
    return out.select("doc_id", "chunk", F.length("body").alias("n"), F.md5("body").alias("digest"))


@query("e14_packed_items", f"""WITH {B.RECORDS_SQL}, l AS (SELECT id, list(key || '：' || value ORDER BY ord) AS p FROM records GROUP BY id), c AS (SELECT id, {packed_sql("p", f"len(regexp_extract_all(i, {q(TOKEN)}))", 30)} AS c FROM l), u AS (SELECT id, unnest(range(len(c)))::INT AS par, unnest(c) AS c FROM c)
SELECT id, par, CASE par % 3 WHEN 0 THEN array_to_string(c.x, '；') WHEN 1 THEN array_to_string(c.x, chr(10)) ELSE array_to_string(c.x, ' ') END AS body FROM u""")
def e14(spark, d):
    return D.packed_items(B.records(spark, d).select("id", "ord", F.concat("key", F.lit("："), "value").alias("line")), 30, ["；", "\n", " "])


@query("e9_breaks_before", """WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '(The |That |Der |Le )', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents WHERE NOT contains(text, chr(1)))
SELECT doc_id, md5(array_to_string(list_reduce(list_transform(CASE WHEN p[1] = '' AND len(p) > 1 THEN p[2:] ELSE p END, lambda x: [x]), lambda a, b: CASE WHEN length(a[-1]) >= 500 THEN list_concat(a, b) ELSE list_append(a[:-2], a[-1] || b[1]) END), chr(10))) AS digest FROM s""")
def e9(spark, d):
    return D.breaks_before(table(spark, d, "documents").select("doc_id", "text"), ["The ", "That ", "Der ", "Le "], 500).select("doc_id", F.md5("text").alias("digest"))


@query("b16_json_object", "SELECT event_id, props AS found FROM events")
def b16(spark, d):
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" or {} done")))
    return table(spark, d, "events").select("event_id", D.json_object(noisy).alias("found"))


@query("b23_cut_at_keywords", r"SELECT doc_id, md5(regexp_replace(text || ' Wort: x', '(?s)((?:Wort|Key)[：:]|\n(?:Wort|Key)).*$', '')) AS digest FROM documents")
def b23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(D.cut_at_keywords(F.concat("text", F.lit(" Wort: x")), ["Wort", "Key"])).alias("digest"))


@query("d4_value_lists", f"""WITH {B.DIALOG_SQL}, o AS (SELECT *, last_value(CASE WHEN type = 'KEY' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY "start", "end") AS key FROM dialog WHERE type <> 'HOSPITAL')
SELECT doc, key, count(*) FILTER (type = 'VALUE') AS n, coalesce(string_agg(CASE WHEN type = 'VALUE' THEN text END, '|' ORDER BY "start"), '') AS listed FROM o WHERE key IS NOT NULL GROUP BY ALL""")
def d4(spark, d):
    by = Window.partitionBy("doc").orderBy("start", "end")
    rows = B.dialog(spark, d).filter("type <> 'HOSPITAL'").withColumn("key", F.last(F.when(F.col("type") == "KEY", F.col("text")), True).over(by)).filter("key is not null")
    v = F.sort_array(F.collect_list(F.when(F.col("type") == "VALUE", F.struct("start", "text"))))
    listed = rows.groupBy("doc", "key").agg(v.alias("v"))
    return listed.select("doc", "key", F.size("v").cast("long").alias("n"), F.array_join(F.transform("v", lambda x: x["text"]), "|").alias("listed"))


@query("d6_title_contents", f"WITH {B.RECORDS_SQL}, f AS (SELECT title, key, value, min(struct_pack(i := id, o := ord)) AS p FROM records GROUP BY ALL) SELECT title, key, count(*) AS n, md5(string_agg(value, '|' ORDER BY p)) AS digest FROM f GROUP BY ALL")
def d6(spark, d):
    first = B.records(spark, d).groupBy("title", "key", "value").agg(F.min(F.struct("id", "ord")).alias("p"))
    listed = first.groupBy("title", "key").agg(F.sort_array(F.collect_list(F.struct("p", "value"))).alias("v"))
    return listed.select("title", "key", F.size("v").cast("long").alias("n"), F.md5(F.array_join(F.transform("v", lambda x: x["value"]), "|")).alias("digest"))


@query("h15_balanced_separators", f"""WITH {B.RECORDS_SQL}, c AS (SELECT id, ord, substr(md5(id || '/' || ord), 1, 2) < '1a' AS blank FROM records),
n AS (SELECT *, count(*) FILTER (NOT blank) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM c)
SELECT id, ord, CASE WHEN blank THEN ' ' WHEN n % 2 = 0 THEN '：' ELSE ':' END AS separator FROM n""")
def h15(spark, d):
    blank = F.substring(F.md5(F.concat_ws("/", F.col("id").cast("string"), F.col("ord").cast("string"))), 1, 2) < "1a"  # a tenth
    return C.balanced_separators(B.records(spark, d), "id", "ord", blank).select("id", "ord", "separator")


@query("e5_key_cuts")
def e5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 9)).alias("keys"))
    return D.cut_at_keys(docs, 60).select("doc_id", "chunk", "start", "end", F.md5("body").alias("digest"))


@query("j3_scorer_queries", f"""WITH {B.KEYS_SQL}, {B.RECORDS_SQL}, known AS (SELECT title, key, string_agg(alias, ' ' ORDER BY ord, alias) AS more FROM aliases GROUP BY ALL)
SELECT id, md5(arg_min(title, ord) || ' ' || string_agg(concat_ws(' ', key, more), ' ' ORDER BY ord, key)) AS digest FROM records LEFT JOIN known USING (title, key) GROUP BY id""")
def j3(spark, d):
    return C.scorer_queries(B.records(spark, d), B.aliases(spark, d)).select("id", F.md5("query").alias("digest"))


@query("j3_examples", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END) AS digest FROM documents")
def j3_examples(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.shown_examples(F.array("text"))[0]).alias("digest"))


@query("h19_folded_fields", f"WITH {B.RECORDS_SQL} SELECT id, string_agg(key || ' ' || value, '；' ORDER BY ord) AS body FROM records GROUP BY id")
def h19(spark, d):
    listed = B.records(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(" ", "key", "value").alias("x")))).alias("v"))
    return listed.select("id", F.array_join(F.transform("v", lambda x: x["x"]), "；").alias("body"))


@query("k1_stream_split", "SELECT event_id, event_type FROM events WHERE ('0x' || substr(md5('ridx:' || event_id), 1, 8))::BIGINT % 10000 < 9000")
def k1(spark, d):
    """The stable split on a stream of the table, appended to files as it comes; the rows of the batch form."""
    source = table(spark, d, "events").select("event_id", "event_type")
    folder = f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select(*source.columns)
    kept = stream.filter(lines.in_training(F.col("event_id"), 0.9))
    kept.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{folder}/rows")


@query("h8_bucket_sizes", "SELECT ('0x' || substr(md5('ridx:' || doc_id), 1, 8))::BIGINT % 10000 // 1000 AS tenth, count(*) AS n FROM documents GROUP BY ALL")
def h8(spark, d):
    return table(spark, d, "documents").groupBy(F.floor(C.bucket("ridx:", F.col("doc_id")) / 1000).alias("tenth")).agg(F.count("*").alias("n"))


@query("e8_breaks_after_values")
def e8(spark, d):
    return D.breaks_after_words(table(spark, d, "documents"), 100).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("e10_sentence_chunks")
def e10(spark, d):
    out = D.sentence_chunks(table(spark, d, "documents").select("doc_id", "text"), ".", 500, 128, 10)
    return out.select("doc_id", "chunk", F.length("body").alias("n"), F.md5("body").alias("digest"))
