"""Inputs of the library made from the driver tables; each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

GOLD_SQL = """gold AS (
    SELECT DISTINCT l_orderkey AS doc, l_linenumber * 100 + l_suppkey % 40 AS "start", l_linenumber * 100 + l_suppkey % 40 + l_quantity::INTEGER AS "end",
           l_returnflag AS type, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE l_partkey::VARCHAR END AS text
    FROM lineitem
)"""
PRED_SQL = """pred AS (
    SELECT DISTINCT l_orderkey AS doc, l_linenumber * 100 + l_suppkey % 40 + (l_partkey % 7 = 0)::INTEGER AS "start",
           l_linenumber * 100 + l_suppkey % 40 + l_quantity::INTEGER AS "end",
           CASE WHEN l_partkey % 11 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'N' ELSE 'A' END ELSE l_returnflag END AS type,
           CASE WHEN l_partkey % 50 = 0 THEN '' WHEN l_partkey % 17 = 0 THEN 'x' || l_partkey::VARCHAR ELSE l_partkey::VARCHAR END AS text
    FROM lineitem WHERE l_partkey % 13 <> 0
)"""
TAGS_SQL = """tags AS (
    SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS idx,
           CASE WHEN l_partkey % 4 = 0 THEN 'O' ELSE ['B', 'I', 'E'][l_partkey % 4] || '-' || l_returnflag END AS label,
           l_suppkey % 9 <> 0 AS mask
    FROM lineitem
), tokens AS (SELECT *, idx * 3 AS s, idx * 3 + CASE WHEN idx % 10 = 9 THEN 0 ELSE 3 END AS e FROM tags)"""
DIALOG_SQL = """spans AS (
    SELECT conv_id AS doc, turn, CASE role WHEN 'user' THEN 'KEY' WHEN 'assistant' THEN 'VALUE' ELSE 'HOSPITAL' END AS type, text,
           coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "start"
    FROM conversations
), dialog AS (SELECT doc, turn, type, text, "start"::BIGINT AS "start", ("start" + length(text))::BIGINT AS "end" FROM spans)"""
KEYS_SQL = """keys AS (
    SELECT p_brand AS title, p_name AS key, min(p_partkey) AS ord FROM part GROUP BY ALL
), aliases AS (
    SELECT p_brand AS title, p_name AS key, p_type AS alias, min(p_partkey) AS ord FROM part GROUP BY ALL
)"""
RECORDS_SQL = """records AS (
    SELECT l_orderkey AS id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, p_brand AS title, p_name AS key, l_partkey::VARCHAR || '/' || l_suppkey::VARCHAR AS value, l_suppkey AS s
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Gold entities (doc, start, end, type, text), as often as the lines name them."""
    start = F.col("l_linenumber") * 100 + F.col("l_suppkey") % 40
    text = F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("type"), text.alias("text"))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold entities (doc, start, end, type, text), once each."""
    return entities(spark, d).distinct()


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Predicted entities: the gold ones, some dropped, shifted, of another type or text."""
    key = F.col("l_partkey")
    base = F.col("l_linenumber") * 100 + F.col("l_suppkey") % 40
    kind = F.when(key % 11 == 0, F.when(F.col("l_returnflag") == "A", "N").otherwise("A")).otherwise(F.col("l_returnflag"))
    text = F.when(key % 50 == 0, "").when(key % 17 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    rows = table(spark, d, "lineitem").filter(key % 13 != 0)
    return rows.select(F.col("l_orderkey").alias("doc"), (base + (key % 7 == 0).cast("int")).alias("start"), (base + F.col("l_quantity").cast("int")).alias("end"), kind.alias("type"), text.alias("text")).distinct()


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Tag sequences (doc, idx, label, mask, s, e)."""
    from pyspark.sql import Window

    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.col("l_partkey") % 4
    prefix = F.when(kind == 1, "B").when(kind == 2, "I").otherwise("E")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.row_number().over(at) - 1).alias("idx"),
        F.when(kind == 0, "O").otherwise(F.concat_ws("-", prefix, "l_returnflag")).alias("label"), (F.col("l_suppkey") % 9 != 0).alias("mask"),
    )
    s = F.col("idx") * 3
    return rows.select("*", s.alias("s"), (s + F.when(F.col("idx") % 10 == 9, 0).otherwise(3)).alias("e"))


def dialog(spark: SparkSession, d: str) -> DataFrame:
    """KEY, VALUE and HOSPITAL spans of the text of a conversation's turns, joined by one character."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    kind = F.when(F.col("role") == "user", "KEY").when(F.col("role") == "assistant", "VALUE").otherwise("HOSPITAL")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", kind.alias("type"), "text", start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.length("text"))


def keys(spark: SparkSession, d: str) -> DataFrame:
    """Structure: the keys (title, key, ord) of each title."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("title"), F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("ord"))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("title"), F.col("p_name").alias("key"), F.col("p_type").alias("alias")).agg(F.min("p_partkey").alias("ord"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """Field rows (id, ord, title, key, value, s): an order's lines, with the part's brand as title and name as key."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    value = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return rows.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ord"), F.col("p_brand").alias("title"), F.col("p_name").alias("key"), value.alias("value"), F.col("l_suppkey").alias("s"))
