"""Readers and writers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TASK_SCHEMA = """id string, data struct<text:string,ocr_text:string,category:string,report_title:string>,
annotations array<struct<id:string,was_cancelled:boolean,updated_at:string,created_at:string,
result:array<struct<id:string,type:string,value:struct<start:int,end:int,text:string,labels:array<string>>,from_id:string,to_id:string,direction:string>>>>"""
OCR_SCHEMA = """page string, words_result array<struct<words:string,location:struct<left:int,top:int,width:int,height:int>,probability:double>>,
paragraphs_result array<struct<words_result_idx:array<int>>>"""
RESERVED = ("report", "report_title", "report_titles", "meta", "added_keys")
CORRUPT = "_corrupt"


def read_records(spark: SparkSession, path, schema: str | StructType, lenient: bool = False, multiline: bool = False) -> DataFrame:
    """JSON lines (or, ``multiline``, arrays).  Bad rows raise; ``lenient`` drops them."""
    if not lenient:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multiline).json(path)
    wide = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    rows = spark.read.schema(wide.add(CORRUPT, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multiline).json(path)
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_exports(spark: SparkSession, paths: Sequence[str], schema: str = TASK_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """The tasks of labelling exports with their ``path``, and what wasn't read: (path, reason, n).

    An export is a JSON array in a file of its own.  Reasons are ``missing`` (a path that leads to no file), ``not an array``
    (a file that doesn't parse, or is something else), and ``not a task`` (elements that aren't objects of the schema, by
    file).  One bad file doesn't touch the others.  A file is one row until its elements are taken apart.
    """
    there, unread = [], []
    for p in dict.fromkeys(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        found = list(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])
        unread += [(x.getPath().toString(), "not an array", 1) for x in found if x.isFile() and not x.getLen()]  # no row comes of these
        if found:
            there.append(p)
        else:
            unread.append((p, "missing", 1))
    missing = spark.createDataFrame(unread, "path string, reason string, n long")
    if there:
        files = spark.read.option("recursiveFileLookup", True).text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    else:
        files = spark.createDataFrame([], "path string, value string")
    array = F.col("value").rlike(r"^[ \t\r\n\x{feff}]*\[") & F.col("value").rlike(r"\][ \t\r\n]*$")
    files = files.select("path", F.when(array, F.from_json(F.ltrim("value", F.lit("\ufeff")), "array<string>")).alias("xs"))
    rows = files.filter("xs is not null").select("path", F.explode("xs").alias("x"))
    rows = rows.select("path", "x", F.when(F.ltrim("x").startswith("{"), F.from_json("x", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})).alias("t"))
    good = F.col("t").isNotNull() & F.col(f"t.{CORRUPT}").isNull()
    broken = files.filter("xs is null").select("path", F.lit("not an array").alias("reason"), F.lit(1).cast("long").alias("n"))
    odd = rows.filter(~good).groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit("not a task").alias("reason"), "n")
    return rows.filter(good).select("path", "t.*").drop(CORRUPT), missing.unionByName(broken).unionByName(odd)


#: Names of the fields of a key dictionary's lines, in order of preference.
TITLE_NAMES, BLOCK_NAME = ("报告名", "报告名称", "report_name"), "键名"
KEY_NAMES, ALIAS_NAMES = ("标准名", "标准名称", "canonical"), ("别名", "aliases", "alias")


def read_key_dictionary(spark: SparkSession, path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structure (title, key, ord), aliases (title, key, alias, ord) and counts (path, kept, skipped, bad) of dictionary lines.

    A line is an object with a title and a block of a key and its aliases: a text, texts, lists whose first element counts, or
    an object with one of these.  Titles, keys and aliases stand in the order in which they first occur; aliases equal to
    their key go.  Lines that don't parse are bad, those without title or key are skipped, blank ones don't count.
    """
    first = lambda m, names: F.coalesce(*[F.when(F.trim(F.try_element_at(m, F.lit(n))) != "", F.trim(F.try_element_at(m, F.lit(n)))) for n in names])
    objects = "map<string,string>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "x")).filter("trim(x) <> ''")
    lines = files.select("path", "line", F.when(F.try_parse_json("x").isNotNull() & F.trim("x").startswith("{"), F.from_json("x", objects)).alias("m"))
    lines = lines.withColumn("b", F.from_json(F.try_element_at("m", F.lit(BLOCK_NAME)), objects))
    lines = lines.select("path", "line", F.col("m").isNull().alias("bad"), first(F.col("m"), TITLE_NAMES).alias("title"), first(F.col("b"), KEY_NAMES).alias("key"), F.try_element_at("b", F.lit("别名")).alias("raw"))
    kept = F.col("title").isNotNull() & F.col("key").isNotNull()
    one = lambda test: F.sum(F.when(test, 1).otherwise(0))
    counts = lines.groupBy("path").agg(one(kept).alias("kept"), one(~kept & ~F.col("bad")).alias("skipped"), one(F.col("bad")).alias("bad"))

    def listed(raw):
        nested = lambda x: F.when(x.startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(0))).when(~x.startswith("{"), x)
        return F.when(raw.startswith("["), F.transform(F.from_json(raw, "array<string>"), nested)).when(~raw.startswith("{"), F.array(raw))

    inner = F.from_json("raw", objects)
    raw = F.when(F.col("raw").startswith("{"), F.coalesce(*[F.try_element_at(inner, F.lit(n)) for n in ALIAS_NAMES])).otherwise(F.col("raw"))
    good = lines.filter(kept).select("path", "line", "title", "key", listed(raw).alias("names"))
    at = F.min(F.struct("path", "line"))
    order = lambda own, *keys: F.row_number().over(Window.partitionBy(*own).orderBy(*keys)) - 1
    structure = good.groupBy("title", "key").agg(at.alias("at")).select("title", "key", order(["title"], "at", "key").alias("ord"))
    names = good.select("path", "line", "title", "key", F.posexplode("names").alias("i", "alias")).withColumn("alias", F.trim("alias")).filter("alias <> '' and alias <> key")
    aliases = names.groupBy("title", "key", "alias").agg(F.min(F.struct("path", "line", "i")).alias("at")).select("title", "key", "alias", order(["title", "key"], "at", "alias").alias("ord"))
    return structure, aliases, counts


def annotation_rows(tasks: DataFrame) -> DataFrame:
    """(task, pos, cancelled, updated_at, created_at, result) of each annotation of tasks of TASK_SCHEMA."""
    rows = tasks.select(F.col("id").alias("task"), F.posexplode("annotations").alias("pos", "a"))
    return rows.select("task", "pos", F.coalesce("a.was_cancelled", F.lit(False)).alias("cancelled"), F.col("a.updated_at"), F.col("a.created_at"), F.col("a.result"))


def entities_and_relations(annotations: DataFrame, labels: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Spans (doc, id, type, start, end, text) by the label map, and relations (doc, from_id, to_id, ord)."""
    rows = annotations.select(F.col("task").alias("doc"), F.posexplode("result").alias("ord", "r"))
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    spans = rows.filter("r.type = 'labels' and r.value.start >= 0 and r.value.end > r.value.start").withColumn("type", F.try_element_at(names, F.get("r.value.labels", F.lit(0))))
    spans = spans.filter("type is not null").select("doc", F.col("r.id").alias("id"), "type", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), F.col("r.value.text").alias("text"))
    return spans, rows.filter("r.type = 'relation'").select("doc", F.col("r.from_id").alias("from_id"), F.col("r.to_id").alias("to_id"), "ord")


def field_rows(lines: DataFrame, exclude_titles: tuple[str, ...] = ()) -> DataFrame:
    """(id, title, key, value, ord) of records with any field names in ``lines(id, value)``; reserved names and blank values are left out."""
    m = lines.select("id", F.from_json("value", "map<string,string>").alias("m")).filter("m is not null")
    m = m.withColumn("title", F.try_element_at("m", F.lit("report_title"))).filter(~F.coalesce(F.col("title").isin(*exclude_titles), F.lit(False)) if exclude_titles else F.lit(True))
    rows = m.select("id", "title", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("id", "title", F.col("e.key").alias("key"), F.col("e.value").alias("value"), "ord")
    return rows.filter(~F.col("key").isin(*RESERVED) & (F.trim(F.coalesce("value", F.lit(""))) != ""))


def dictionary_rows(nodes: DataFrame) -> DataFrame:
    """(title, key, alias, ord) of ``nodes(title, value)``; a value is an array of keys or an object of key to alias, aliases or {别名: ...}."""
    keys = nodes.select("title", F.from_json("value", "array<string>").alias("a"), F.from_json("value", "map<string,string>").alias("m"))
    plain = keys.filter("a is not null").select("title", F.posexplode("a").alias("ord", "key"), F.lit(None).cast("string").alias("raw"))
    named = keys.filter("a is null and m is not null").select("title", F.posexplode(F.map_entries("m")).alias("ord", "e")).select("title", "ord", F.col("e.key").alias("key"), F.col("e.value").alias("raw"))
    rows = plain.select("title", "ord", "key", "raw").unionByName(named)
    inner = F.coalesce(F.get_json_object("raw", "$['别名']"), F.col("raw"))
    aliases = F.coalesce(F.from_json(inner, "array<string>"), F.array(inner))
    return rows.select("title", "key", "ord", F.explode_outer(F.filter(aliases, lambda x: x.isNotNull() & (F.trim(x) != "") & (x != F.col("key")) & ~x.startswith("{"))).alias("alias"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .txt files under folders U*, but not those named _all* and not empty ones."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.filter(F.col("path").rlike(r"/U[^/]*/") & ~F.col("path").rlike(r"/_all[^/]*$") & (F.trim("text") != ""))


def ocr_lines(pages: DataFrame) -> DataFrame:
    """(page, line, words, left, top, right, bottom) of pages of OCR_SCHEMA."""
    rows = pages.select("page", F.posexplode("words_result").alias("line", "w"))
    box = F.col("w.location")
    return rows.select("page", "line", F.col("w.words").alias("words"), box["left"].alias("left"), box["top"].alias("top"), (box["left"] + box["width"]).alias("right"), (box["top"] + box["height"]).alias("bottom"))


def ocr_paragraphs(pages: DataFrame) -> DataFrame:
    """(page, text): lines joined within paragraphs, paragraphs by a blank line."""
    line = lambda i: F.coalesce(F.get("words_result", i)["words"], F.lit(""))
    return pages.select("page", F.array_join(F.transform("paragraphs_result", lambda p: F.array_join(F.transform(p["words_result_idx"], line), "")), "\n\n").alias("text"))


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """One folder for each ``split``; returns the counts."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def review_tasks(records: DataFrame) -> DataFrame:
    """(id, table, body) of records(id, key, value, ord): an HTML table of the fields, escaped, and them as JSON."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    listed = records.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "key", "value"))).alias("f"))
    cells = F.transform("f", lambda x: F.concat(F.lit("<tr><td>"), safe(x["key"]), F.lit("</td><td>"), safe(x["value"]), F.lit("</td></tr>")))
    return listed.select("id", F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>")).alias("table"), F.to_json(F.transform("f", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))).alias("body"))
