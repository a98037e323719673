"""Chunks of long texts with exact offsets.  Frames hold (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORD = r"[^ \t\n]+[ \t\n]*"


def token_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` tokens that share ``overlap``: doc_id, chunk, first_token, end_token, chunk_text; short texts are one."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the window")
    stride = size - overlap
    rows = docs.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n", F.size("w"))
    starts = F.when(F.col("n") <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(stride)), lambda i: (i == 0) | (i + overlap < F.col("n"))))
    rows = rows.select("doc_id", "text", "w", "n", F.posexplode(starts).alias("chunk", "first_token"))
    end = F.least(F.col("first_token") + size, F.col("n"))
    body = F.when(F.col("n") <= size, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("first_token") + 1, end - F.col("first_token")), ""))
    return rows.select("doc_id", "chunk", "first_token", end.alias("end_token"), body.alias("chunk_text"))


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, par, char_start, char_end, body, tokens); a separator at the end makes no empty paragraph."""
    rows = docs.select("doc_id", F.split("text", "\\Q" + separator + "\\E").alias("p"))
    rows = rows.select("doc_id", "p", F.posexplode("p").alias("par", "body")).filter(~((F.col("par") == F.size("p") - 1) & (F.col("body") == "") & (F.col("par") > 0)))
    before = F.aggregate(F.slice("p", F.lit(1), F.col("par")), F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) + len(separator))
    return rows.select("doc_id", "par", before.alias("char_start"), (before + F.length("body")).alias("char_end"), "body", T.token_count(F.col("body")).alias("tokens"))


def packed(pars: DataFrame, budget: int) -> DataFrame:
    """Neighbouring paragraphs packed while their tokens stay within ``budget``: (doc_id, chunk, first_par, end_par, tokens)."""
    listed = pars.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("par", F.col("tokens").cast("int").alias("tokens")))).alias("p"))
    none = F.expr("cast(array() as array<struct<first_par:int,end_par:int,tokens:int>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["tokens"] + x["tokens"] <= budget)
        longer = F.struct(last["first_par"].alias("first_par"), (x["par"] + 1).alias("end_par"), (last["tokens"] + x["tokens"]).alias("tokens"))
        new = F.struct(x["par"].alias("first_par"), (x["par"] + 1).alias("end_par"), x["tokens"].alias("tokens"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    return listed.select("doc_id", F.posexplode(F.aggregate("p", none, add)).alias("chunk", "c")).select("doc_id", "chunk", "c.*")


def sections(docs: DataFrame, headings: list[str]) -> DataFrame:
    """Texts cut before each of ``headings``: (doc_id, section, heading, body); what stands before the first has no heading."""
    pattern = "(?=" + "|".join("\\Q" + h + "\\E" for h in headings) + ")"
    rows = docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("section", "part"))
    heading = F.regexp_extract("part", "^(" + "|".join("\\Q" + h + "\\E" for h in headings) + ")", 1)
    return rows.select("doc_id", "section", heading.alias("heading"), F.substring("part", F.length(heading) + 1, F.length("part")).alias("body"))
