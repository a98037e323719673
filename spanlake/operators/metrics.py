"""Scores of predicted spans against gold ones.  Frames hold (doc, start, end, type, text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import once as held
from .lists import by_doc

SPAN = ["doc", "start", "end", "type"]


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, rounded to 6 places; 0 where undefined."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(over(2 * p * r, p + r), 6).alias("f1")]


def once(entities: DataFrame) -> DataFrame:
    """Entities with a text count once; those without are never equal to each other, so each counts."""
    named = F.coalesce("text", F.lit("")) != ""
    usable = entities.filter("start is not null and end is not null and type is not null").withColumn("text", F.coalesce("text", F.lit("")))
    return usable.filter(named).dropDuplicates([*SPAN, "text"]).unionByName(usable.filter(~named))


def _counts(pred: DataFrame, gold: DataFrame, by_type: bool) -> DataFrame:
    """tp, fp, fn and rates from matched flags; overall as type null, with each type if ``by_type``."""
    hit, named = F.col("matched"), F.col("text") != ""
    rows = pred.select("type", (hit & named).cast("long").alias("tp"), (~hit).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))
    return _summed(rows.unionByName(gold.select("type", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn"))), by_type)


def _summed(rows: DataFrame, by_type: bool) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    grouped = rows.rollup("type").agg(*sums) if by_type else rows.agg(*sums).select(F.lit(None).cast("string").alias("type"), "*")
    return grouped.select(F.coalesce("type", F.lit("overall")).alias("type"), "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def _flag(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(others.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left").withColumn("matched", F.coalesce("hit", F.lit(False))).drop("hit")


def strict(gold: DataFrame, pred: DataFrame, by_type: bool = True) -> DataFrame:
    """Equal place, type and text.  Two entities without text match, but only texts count as true positives."""
    g, p = once(gold), once(pred)
    return _counts(_flag(p, g, [*SPAN, "text"]), _flag(g, p, [*SPAN, "text"]), by_type)


def overlapping(rows: DataFrame, others: DataFrame, kind: str) -> DataFrame:
    """Rows that overlap one of ``others`` (kind: left_semi), or none (left_anti)."""
    o = others.select(*(F.col(c).alias(f"o_{c}") for c in (*SPAN, "text")))
    same = (F.col("doc") == F.col("o_doc")) & (F.col("type") == F.col("o_type")) & ((F.col("text") == "") == (F.col("o_text") == ""))
    return rows.join(o, same & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end")), kind)


def overlap(gold: DataFrame, pred: DataFrame, by_type: bool = True) -> DataFrame:
    """Any overlap within a type counts; several predictions may match one gold entity.

    Both sides of a document meet as lists in its row: each is read and dealt once.
    """
    usable = lambda rows: rows.filter("start is not null and end is not null and type is not null").select("doc", "start", "end", "type", F.coalesce("text", F.lit("")).alias("text"))
    named = lambda x: x["text"] != ""
    # As in ``once``: those with a text count once, the others each.
    listed = lambda c: F.concat(F.array_distinct(F.filter(c, named)), F.filter(c, lambda x: ~named(x)))
    rows = by_doc(g=usable(gold), p=usable(pred)).select("doc", listed("g").alias("g"), listed("p").alias("p"))
    # Documents without a number are nobody's: their entities match nothing.
    met = lambda x, others: F.col("doc").isNotNull() & F.exists(others, lambda y: (x["type"] == y["type"]) & (named(x) == named(y)) & (x["start"] < y["end"]) & (y["start"] < x["end"]))
    count = lambda x, tp, fp, fn: F.struct(x["type"].alias("type"), *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    no = F.lit(False)
    predicted = F.transform("p", lambda x: held(met(x, F.col("g")), lambda hit: count(x, hit & named(x), ~hit, no)))
    true = F.transform("g", lambda x: count(x, no, no, ~met(x, F.col("p"))))
    return _summed(rows.select(F.explode(F.concat(predicted, true)).alias("x")).select("x.*"), by_type)


def untyped(entities: DataFrame) -> DataFrame:
    return entities.filter("start is not null and end is not null and text is not null").select("doc", "start", "end", "text").distinct()


def one_to_one(gold: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """One-to-one matches per document on equal ``on``: the smaller of both counts for each value."""
    keys = ["doc", *on]
    g, p = untyped(gold).groupBy(keys).agg(F.count("*").alias("g")), untyped(pred).groupBy(keys).agg(F.count("*").alias("p"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = g.join(p, keys, "full").select("doc", n("g").alias("g"), n("p").alias("p"))
    per = both.groupBy("doc").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    return per.select("doc", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def pooled(per_doc: DataFrame) -> DataFrame:
    s = per_doc.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    return s.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def averaged(per_doc: DataFrame) -> DataFrame:
    """Rates averaged over documents that have anything on either side; counts summed."""
    some = per_doc.filter("tp + fp + fn > 0")
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    rows = some.select("*", p.alias("p"), r.alias("r"), over(2 * p * r, p + r).alias("f"))
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))]
    return rows.agg(F.count("*").alias("docs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), *means)


def greedy(gold: DataFrame, pred: DataFrame, match) -> DataFrame:
    """One-to-one matches by ``match(pred text, gold text)``: predictions by (start, end, text), each takes the first free gold one."""

    @F.pandas_udf("long")
    def taken(p: pd.Series, g: pd.Series) -> pd.Series:
        def count(ps, gs) -> int:
            free, n = [x["text"] for x in gs] if gs is not None else [], 0
            for x in ps if ps is not None else ():
                at = next((i for i, y in enumerate(free) if match(x["text"], y)), None)
                if at is not None:
                    del free[at]
                    n += 1
            return n

        return pd.Series([count(a, b) for a, b in zip(p, g, strict=True)])

    listed = lambda rows, name: untyped(rows).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end", "text"))).alias(name))
    both = listed(pred, "p").join(listed(gold, "g"), "doc", "full").withColumn("tp", taken("p", "g"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return both.select("doc", "tp", (size("p") - F.col("tp")).alias("fp"), (size("g") - F.col("tp")).alias("fn"))


def contains_either(a: str, b: str) -> bool:
    return a in b or b in a


def similar(threshold: float, lexicon: dict[tuple[str, str], float] | None = None):
    """Texts alike by the lexicon, either way round, or else by the Jaccard index of their characters."""

    def score(a: str, b: str) -> float:
        if not a or not b:
            return 0.0
        for pair in ((a, b), (b, a)):
            if lexicon and pair in lexicon:
                return lexicon[pair]
        x, y = set(a), set(b)
        return len(x & y) / len(x | y)

    return lambda a, b: score(a, b) >= threshold


def conflicts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs that share a start or an end but differ otherwise in place or type: (doc, place, at, gold, pred)."""
    g, p = (x.select(*SPAN).distinct() for x in (gold, pred))
    p = p.select(F.col("doc"), *(F.col(c).alias(f"p_{c}") for c in SPAN[1:]))
    out = []
    for side, other in (("start", "end"), ("end", "start")):
        rows = g.join(p, "doc").filter((F.col(side) == F.col(f"p_{side}")) & ((F.col(other) != F.col(f"p_{other}")) | (F.col("type") != F.col("p_type"))))
        show = lambda pre: F.concat_ws(",", *(F.col(f"{pre}{c}").cast("string") for c in SPAN[1:]))
        out.append(rows.select("doc", F.lit(side).alias("place"), F.col(side).alias("at"), show("").alias("gold"), show("p_").alias("pred")))
    return out[0].unionByName(out[1])


def evaluate(gold: DataFrame, pred: DataFrame, mode: str = "typed", strict_match: bool = True, method: str = "position", text_mode: str = "exact", threshold: float = 0.8, validate: bool = False, documents: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One entry for all modes; bad arguments and (on request) conflicts raise ValueError.

    A document without rows has no entities.  ``documents`` may give the two sides' documents (doc); they must be the same.
    """
    if mode not in ("typed", "untyped"):
        raise ValueError("mode is typed or untyped")
    if method not in ("position", "text") or text_mode not in ("exact", "overlap", "similarity"):
        raise ValueError("method is position or text; text_mode is exact, overlap or similarity")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold lies between 0 and 1")
    if documents is not None:
        a, b = (x.select("doc").distinct() for x in documents)
        if not (a.join(b, "doc", "left_anti").isEmpty() and b.join(a, "doc", "left_anti").isEmpty()):
            raise ValueError("gold and predictions are of different documents")
    if validate and not conflicts(gold, pred).isEmpty():
        raise ValueError("positions conflict")
    if mode == "typed":
        return (strict if strict_match else overlap)(gold, pred)
    if method == "position":
        return pooled(one_to_one(gold, pred, ["start", "end"]))
    if text_mode == "exact":
        return pooled(one_to_one(gold, pred, ["text"]))
    return pooled(greedy(gold, pred, contains_either if text_mode == "overlap" else similar(threshold)))
