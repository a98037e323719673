"""Samples for question answering: which part of a text a question is asked of.  Rows hold ranges of characters, not texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .curate import keep_negatives

#: Marks that an answer loses at its end; places of a question and its context taken by special tokens.
ANSWER_TAIL = "，。,；;、:：)]）】>》"
SPECIAL_TOKENS = 3


def paragraph_ranges(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, ranges) of docs(doc_id, text): (par, start, end, tokens) of each paragraph; a separator at the end makes none.

    Offsets are running sums over small rows of lengths, so a text is split once and moved nowhere.
    """
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\\Q" + separator + "\\E")).alias("par", "body"))
    rows = rows.select("doc_id", "par", F.length("body").alias("n"), T.token_count(F.col("body")).cast("int").alias("tokens"))
    by = Window.partitionBy("doc_id").orderBy("par")
    start = F.coalesce(F.sum(F.col("n") + len(separator)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("start", start).withColumn("last", F.lead("par").over(by).isNull()).filter("not (last and n = 0 and par > 0)")
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("par", "start", (F.col("start") + F.col("n")).alias("end"), "tokens"))).alias("ranges"))


def _tightened(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end of an answer without white space at its edges and marks at its end."""
    value = F.substr(text, start + 1, end - start)
    left = F.ltrim(value, F.lit(T.SPACES))
    s = start + F.length(value) - F.length(left)
    return s, s + F.length(F.rtrim(F.rtrim(left, F.lit(T.SPACES)), F.lit(ANSWER_TAIL)))


def _windows(n: Column) -> Column:
    """Windows of min(5, max(3, n / 4)) of ``n`` paragraphs at half steps, up to the first that reaches the end; of three or fewer, all."""
    size = F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n / 4)))
    step = F.greatest(F.lit(1), F.floor(size / 2))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    wide = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((i * step).alias("first"), (F.least(i * step + size, n) - 1).alias("last")))
    return F.when(n > 3, wide).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("first"), (n - 1).cast("long").alias("last"))))


def question_samples(docs: DataFrame, questions: DataFrame, most: int, sequence: int, keep: float | None = 1.0, separator: str = "\n\n") -> DataFrame:
    """(doc_id, key, chunk, kind, char_start, char_end, answer_start, answer_end) of docs(doc_id, text) and
    questions(doc_id, key, question, start, end, present).

    A question with an answer (``start`` is not -1) is asked of the answer's paragraphs and one more; without, of windows
    of paragraphs, or of a text of three paragraphs or fewer.  A part with more tokens than fit beside the question
    (``most`` in all, ``sequence`` with it) is taken paragraph by paragraph.  Answers lose spaces and marks at their edges;
    a chunk that cuts its answer gives no sample.  ``answer_start`` and ``answer_end`` are places in the chunk, -1 in
    negatives.  Of these a share ``keep`` stays, a fifth of it where the field isn't ``present``; None keeps all.

    Documents that are null, empty or without questions give nothing; so do questions with null ids.
    """
    listed = questions.groupBy("doc_id").agg(F.collect_list(F.struct("key", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("end", F.lit(-1)).alias("end"), F.coalesce("present", F.lit(False)).alias("present"), T.token_count(F.coalesce("question", F.lit(""))).alias("asked"))).alias("qs"))

    def tight(q: Column) -> Column:
        s, e = _tightened(F.col("text"), q["start"], q["end"])
        found = (q["start"] >= 0) & (q["end"] > q["start"])
        budget = F.greatest(F.lit(1), F.least(F.lit(most), F.lit(sequence) - q["asked"] - SPECIAL_TOKENS))
        return F.struct(q["key"].alias("key"), q["present"].alias("present"), q["start"].alias("start"), q["end"].alias("end"), found.alias("found"), s.alias("s"), e.alias("e"), budget.alias("budget"))

    kept = docs.filter("text <> ''").select("doc_id", "text")
    rows = kept.join(listed, "doc_id").select("doc_id", F.length("text").alias("size"), F.transform("qs", tight).alias("qs")).join(paragraph_ranges(kept, separator), "doc_id")
    rows = rows.select("doc_id", "size", "ranges", F.size("ranges").alias("n"), F.explode("qs").alias("q")).select("doc_id", "size", "ranges", "n", "q.*")

    at = lambda i: F.get("ranges", i.cast("int"))
    holds = lambda test, default: F.coalesce(F.get(F.filter("ranges", test), F.lit(0))["par"].cast("long"), default)
    first = holds(lambda r: (r["start"] <= F.col("start")) & (F.col("start") < r["end"]), F.lit(0).cast("long"))
    last = holds(lambda r: (r["start"] < F.col("end")) & (F.col("end") <= r["end"]), (F.col("n") - 1).cast("long"))
    around = F.array(F.struct(first.alias("first"), F.least(last + 1, F.col("n") - 1).alias("last")))
    parts = F.when(F.col("found"), around).otherwise(_windows(F.col("n")))

    def cut(p: Column) -> Column:
        own = F.slice("ranges", p["first"].cast("int") + 1, F.greatest(p["last"] - p["first"] + 1, F.lit(0)).cast("int"))
        tokens = F.aggregate(own, F.lit(0), lambda s, r: s + r["tokens"])
        pieces = F.transform(F.filter(own, lambda r: r["end"] > r["start"]), lambda r: F.struct(r["start"].alias("char_start"), r["end"].alias("char_end")))
        whole = ~F.col("found") & (F.col("n") <= 3)
        one = F.struct(F.when(whole, 0).otherwise(at(p["first"])["start"]).alias("char_start"), F.when(whole, F.col("size")).otherwise(at(p["last"])["end"]).alias("char_end"))
        return F.when((tokens > F.col("budget")) & (p["last"] > p["first"]), pieces).otherwise(F.array(one))

    rows = rows.select("doc_id", "key", "present", "found", "s", "e", F.posexplode(F.flatten(F.transform(parts, cut))).alias("chunk", "c")).select("*", "c.*")
    rows = rows.filter(~F.col("found") | ((F.col("s") >= F.col("char_start")) & (F.col("e") <= F.col("char_end"))))
    positive = F.col("found") & (F.col("e") > F.col("s"))
    rows = rows.withColumn("kind", F.when(positive, "positive").otherwise("negative"))
    if keep is not None:
        rows = keep_negatives(rows, F.col("kind") == "negative", ~F.col("present"), keep, F.concat_ws("/", F.col("doc_id").cast("string"), "key", F.col("chunk").cast("string")))
    place = lambda c: F.when(positive, F.col(c) - F.col("char_start")).otherwise(-1)
    return rows.select("doc_id", "key", "chunk", "kind", "char_start", "char_end", place("s").alias("answer_start"), place("e").alias("answer_end"))
