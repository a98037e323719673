"""Queries that write the driver tables in the formats of the library's readers and read them back; files go to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import curate as C
from ..sources import io, sinks
from ..streaming import lines
from .q_keys import BUCKET
from .registry import query, table


def folder(spark, name):
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_lenient_records", "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 3")
def a1(spark, d):
    """JSON lines, some of them cut short."""
    line = F.to_json(F.struct("event_id", "event_type"))
    at = folder(spark, "a1")
    table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 3, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value")).write.text(at)
    return io.read_records(spark, at, "event_id long, event_type string", lenient=True)


def exports(spark, d):
    """Conversations as labelling exports of 20 each; of five files one is cut short, and one is no array."""
    name = lambda c: F.col(c).cast("string")
    one = F.struct(name("turn").alias("id"), F.lit(False).alias("was_cancelled"), name("turn").alias("updated_at"))
    tasks = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("annotations"))
    task = F.to_json(F.struct(name("conv_id").alias("id"), F.struct(F.concat(F.lit("text "), name("conv_id")).alias("text")).alias("data"), "annotations"))
    files = tasks.groupBy(F.floor(F.col("conv_id") / 20).alias("g")).agg(F.array_join(F.collect_list(task), ",").alias("x"))
    kind = F.col("g") % 5
    at = folder(spark, "a2")
    files.select("g", F.when(kind == 3, F.concat(F.lit("["), "x")).when(kind == 4, F.concat(F.lit('{"all":['), "x", F.lit("]}"))).otherwise(F.concat(F.lit("["), "x", F.lit("]"))).alias("value")).write.partitionBy("g").text(at)
    return io.read_exports(spark, [f"{at}/g=*", f"{at}/nowhere.json"])


@query("a2_exports", "SELECT conv_id::VARCHAR AS task, count(*) AS n FROM conversations WHERE (conv_id // 20) % 5 < 3 GROUP BY conv_id")
def a2(spark, d):
    return io.annotation_rows(exports(spark, d)[0]).groupBy("task").agg(F.count("*").alias("n"))


@query("a2_export_problems", "SELECT 'not an array' AS reason, count(DISTINCT conv_id // 20) AS n FROM conversations WHERE (conv_id // 20) % 5 >= 3 HAVING count(*) > 0 UNION ALL SELECT 'missing', 1")
def a2_problems(spark, d):
    return exports(spark, d)[1].groupBy("reason").agg(F.sum("n").alias("n"))


NODES_SQL = "nodes AS (SELECT p_brand AS title, p_name AS key, min(p_type) AS alias, min(p_partkey) AS pos FROM part GROUP BY ALL)"


@query("a4_dictionary", f"WITH {NODES_SQL} SELECT title, key, CASE WHEN pos % 3 = 0 THEN NULL ELSE alias END AS alias FROM nodes")
def a4(spark, d):
    """Keys of a brand in three nodes: a list of keys, keys with an alias, keys with a list of aliases."""
    nodes = table(spark, d, "part").groupBy(F.col("p_brand").alias("title"), F.col("p_name").alias("key")).agg(F.min("p_type").alias("alias"), F.min("p_partkey").alias("at"))
    of = lambda value: F.to_json(F.map_from_entries(F.collect_list(F.struct("key", value))))
    rows = nodes.groupBy("title", (F.col("at") % 3).alias("kind")).agg(F.to_json(F.collect_list("key")).alias("list"), of(F.col("alias")).alias("plain"), of(F.create_map(F.lit("别名"), F.array("alias"))).alias("named"))
    rows = rows.select("title", F.when(F.col("kind") == 0, F.col("list")).when(F.col("kind") == 1, F.col("plain")).otherwise(F.col("named")).alias("value"))
    return io.dictionary_rows(rows).select("title", "key", "alias")


def dictionary(spark, d):
    """Parts as lines of a key dictionary, a file for each brand; some lines are broken, some have no key."""
    p = table(spark, d, "part")
    quoted = F.to_json(F.array("p_type"))
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.substr(quoted, F.lit(2), F.length(quoted) - 2)).when(kind == 1, quoted).when(kind == 2, F.concat(F.lit("["), F.to_json(F.array("p_type", F.lit(""))), F.lit("]"))).otherwise(F.concat(F.lit('{"aliases":'), quoted, F.lit("}")))
    key = F.when(F.col("p_partkey") % 13 == 5, "").otherwise(F.col("p_name"))
    line = F.concat(F.lit('{"报告名":"'), "p_brand", F.lit('","键名":{"标准名":"'), key, F.lit('","别名":'), raw, F.lit("}}"))
    line = F.when(F.col("p_partkey") % 11 == 7, F.substr(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    at = folder(spark, "a5")
    p.select("p_brand", "p_partkey", line.alias("value")).repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey").select("p_brand", "value").write.partitionBy("p_brand").text(at)
    return io.read_key_dictionary(spark, f"{at}/p_brand=*")


GOOD = "p_partkey % 11 <> 7 AND p_partkey % 13 <> 5"


@query("a5_structure", f"SELECT p_brand AS title, p_name AS key, (row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1)::INT AS ord FROM part WHERE {GOOD} GROUP BY p_brand, p_name")
def a5(spark, d):
    return dictionary(spark, d)[0]


@query("a5_aliases", f"SELECT p_brand AS title, p_name AS key, p_type AS alias, (row_number() OVER (PARTITION BY p_brand, p_name ORDER BY min(p_partkey)) - 1)::INT AS ord FROM part WHERE {GOOD} AND p_type <> p_name GROUP BY p_brand, p_name, p_type")
def a5_aliases(spark, d):
    return dictionary(spark, d)[1]


@query("a5_counts", f"SELECT count(*) FILTER ({GOOD}) AS kept, count(*) FILTER (p_partkey % 11 <> 7 AND p_partkey % 13 = 5) AS skipped, count(*) FILTER (p_partkey % 11 = 7) AS bad FROM part GROUP BY p_brand")
def a5_counts(spark, d):
    return dictionary(spark, d)[2].drop("path")


@query("a6_text_files", "SELECT md5(text) AS digest FROM benchmark WHERE item_id % 4 <> 0 AND trim(text) <> ''")
def a6(spark, d):
    """Items as text files, three of four in folders that begin with U."""
    at = folder(spark, "a6")
    rows = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 4).alias("k"), F.col("text").alias("value"))
    for name, some in (("U", rows.filter("k <> 0")), ("other", rows.filter("k = 0"))):
        some.drop("k").write.partitionBy("item_id").option("lineSep", "\x00").option("compression", "none").text(f"{at}/{name}1")
    return io.text_files(spark, at).select(F.md5(F.rtrim("text", F.lit("\x00"))).alias("digest"))


@query("a8_versions", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def a8(spark, d):
    """Two versions of one output; readers see the second."""
    at, rows = folder(spark, "a8"), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.write_version(rows, at)
    sinks.write_version(rows.filter("c_custkey % 2 = 0"), at)
    return sinks.read_version(spark, at)


SPLIT_SQL = f"(SELECT o_orderkey, {BUCKET.format(chr(39) + 'out:' + chr(39) + ' || o_orderkey')} AS b FROM orders)"
OUTPUTS = (("train", 7000), ("val", 8000), ("eval", 8500), ("da_eval", 9000), ("test", 10_000))


@query("a9_outputs", f"SELECT split, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (SELECT *, CASE {' '.join(f'WHEN b < {e} THEN {chr(39)}{n}{chr(39)}' for n, e in OUTPUTS)} END AS split FROM {SPLIT_SQL}) WHERE split IN ('train', 'eval', 'test') GROUP BY split")
def a9(spark, d):
    """Orders dealt to five outputs, of which three are selected."""
    b, split = C.bucket(F.lit("out:"), F.col("o_orderkey")), None
    for name, edge in OUTPUTS:
        split = F.when(b < edge, name) if split is None else split.when(b < edge, name)
    at = folder(spark, "a9")
    sinks.write_version(table(spark, d, "orders").select("o_orderkey", split.alias("split")), at, ["train", "eval", "test"], format="parquet")
    return sinks.read_version(spark, at).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("k2_appended", "SELECT event_id, event_type FROM events WHERE event_type <> 'purchase'")
def k2(spark, d):
    """A stream of the table, appended batch by batch, each once."""
    at, events = folder(spark, "k2"), table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]").filter("event_type <> 'purchase'").select("event_id", "event_type")
    lines.append_once(stream, f"{at}/rows", f"{at}/state", format="parquet", once=True).awaitTermination()
    return lines.read_appended(spark, f"{at}/rows", "event_id long, event_type string", "parquet").drop("batch")
