"""Paragraph breaks from the layout of scanned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Shares of the page's width and least sizes of a gap at the right and of an indent; what numbers a line;
# characters by which the two sides of a break may repeat each other.
RIGHT_SHARE, RIGHT_LEAST, INDENT_SHARE, INDENT_LEAST = 0.20, 12.0, 0.12, 8.0
NUMBERED = r"^[ \t\n\r\x0b\x0c\x{a0}\x{3000}]*([0-9]+|[一二三四五六七八九十百千]+|[ivxlcdmIVXLCDM]+)"
STOP = "。"
REPEAT_MOST, REPEAT_LEAST = 30, 6


def starts_numbered(c: Column) -> Column:
    """A line that begins with a number: digits, Chinese or Roman numerals."""
    return F.coalesce(c.rlike(NUMBERED), F.lit(False))


def ends_sentence(c: Column) -> Column:
    return F.coalesce(F.rtrim(c, F.lit(T.SPACES)).endswith(STOP), F.lit(False))


#: Marks after which, and before which, no space is put between two pieces of a line.
OPENERS, CLOSERS = "([{（【\"'“‘", ")]}）】\"'”’.,，。!！?？:：;；、"


def needs_space(before: Column, after: Column) -> Column:
    """Whether two pieces of a line need a space between them: not at its ends, beside brackets and marks, or where one is."""
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    some = (F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != "")
    return some & ~F.contains(F.lit(OPENERS), last) & ~F.contains(F.lit(CLOSERS), first) & ~last.isin(" ", "\t") & ~first.isin(" ", "\t")


def without_repeat(left: Column, right: Column) -> Column:
    """``right`` without a beginning that repeats the end of ``left``: the longest of 6 to 30 characters."""
    fits = lambda k: (k <= F.length(left)) & (k <= F.length(right)) & F.startswith(right, F.right(left, k))
    k = F.get(F.filter(F.sequence(F.lit(REPEAT_MOST), F.lit(REPEAT_LEAST), F.lit(-1)), fits), F.lit(0))
    return F.substr(right, F.coalesce(k, F.lit(0)) + 1)


def break_places(lines: DataFrame, limit: int) -> DataFrame:
    """(doc, at): the line of lines(doc, line, words, left, right) behind which a text of more than ``limit`` tokens is broken.

    The nearest place behind the line where the limit is reached, else before it, at which a line ends early, or ends a
    sentence and the next isn't an indented numbered one; else the nearest end of a sentence in the same order; else that
    line itself.  Texts within the limit, and those of one line, have no break.
    """
    lines = lines.select("doc", "line", "words", "left", "right")
    doc, by = Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("line")
    inked = F.btrim(F.coalesce("words", F.lit("")), F.lit(T.SPACES)) != ""
    rows = lines.withColumn("tokens", F.coalesce(T.token_count(F.col("words")), F.lit(0))).withColumns({
        "i": F.row_number().over(by) - 1, "n": F.count("*").over(doc), "total": F.sum("tokens").over(doc), "sum": F.sum("tokens").over(by),
        "low": F.coalesce(F.min(F.when(inked, F.col("left"))).over(doc), F.lit(0.0)), "high": F.coalesce(F.max(F.when(inked, F.col("right"))).over(doc), F.lit(0.0)),
        "next_words": F.lead("words").over(by), "next_left": F.lead("left").over(by),
    }).filter((F.col("total") > limit) & (F.col("n") > 1))
    rows = rows.withColumn("near", F.least(F.min(F.when(F.col("sum") >= limit, F.col("i"))).over(doc), F.col("n") - 2))
    width = F.greatest(F.lit(1.0), F.col("high") - F.col("low"))
    early = F.greatest(F.lit(0.0), F.col("high") - F.col("right")) > F.greatest(width * RIGHT_SHARE, F.lit(RIGHT_LEAST))
    flush = F.greatest(F.lit(0.0), F.col("next_left") - F.col("low")) <= F.greatest(width * INDENT_SHARE, F.lit(INDENT_LEAST))
    both = F.col("words").isNotNull() & F.col("next_words").isNotNull() & (F.concat("words", "next_words") != "")
    period = ends_sentence(F.col("words"))
    natural = both & (early | (period & (flush | ~starts_numbered(F.col("next_words")))))
    ahead, apart = F.col("i") >= F.col("near"), F.abs(F.col("i") - F.col("near"))
    rank = F.when(natural & ahead, 0).when(natural, 1).when(period & ahead, 2).when(period, 3).when(apart == 0, 4)
    rows = rows.filter("i < n - 1").withColumn("rank", rank).filter("rank is not null")
    return rows.groupBy("doc").agg(F.min_by("line", F.struct("rank", apart.alias("apart"))).alias("at"))


def layout_breaks(lines: DataFrame, limit: int, joiner: str = " ") -> DataFrame:
    """(doc, text) of lines(doc, line, words, left, right): the lines joined in order, with one blank line at ``break_places``.

    Runs of blanks become one; what the second part repeats of the first one's end goes.  Null lines are left out.
    """
    listed = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("x")).join(break_places(lines, limit), "doc", "left")

    def joined(test) -> Column:
        own = F.transform(F.filter("x", lambda r: r["words"].isNotNull() & test(r["line"])), lambda r: r["words"])
        return F.btrim(F.regexp_replace(F.array_join(own, joiner), "[ \t]+", " "), F.lit(T.SPACES))

    rows = listed.select("doc", "at", F.when(F.col("at").isNull(), joined(lambda i: F.lit(True))).alias("whole"), joined(lambda i: i <= F.col("at")).alias("l"), joined(lambda i: i > F.col("at")).alias("r"))
    broken = F.btrim(F.concat("l", F.lit("\n\n"), without_repeat(F.col("l"), F.col("r"))), F.lit(T.SPACES))
    return rows.select("doc", F.coalesce("whole", broken).alias("text"))
