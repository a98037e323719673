"""Queries of the metric operators over the lineitem entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from . import bindings as B
from .registry import query

RATES = """round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"""
PR = """SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""


def typed_sql(cond: str) -> str:
    return f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, rows AS (
    SELECT p.type, (m AND text <> '')::BIGINT AS tp, (NOT m)::BIGINT AS fp, 0 AS fn
    FROM (SELECT p.*, EXISTS (SELECT 1 FROM gold g WHERE {cond.format(a="p", b="g")}) AS m FROM pred p) p
    UNION ALL
    SELECT g.type, 0, 0, (NOT m)::BIGINT
    FROM (SELECT g.*, EXISTS (SELECT 1 FROM pred p WHERE {cond.format(a="g", b="p")}) AS m FROM gold g) g
), sums AS (
    SELECT coalesce(type, 'overall') AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM rows GROUP BY ROLLUP (type)
), rated AS ({PR} FROM sums)
SELECT type, tp, fp, fn, {RATES} FROM rated
"""


STRICT = '{a}.doc = {b}.doc AND {a}."start" = {b}."start" AND {a}."end" = {b}."end" AND {a}.type = {b}.type AND {a}.text = {b}.text'
OVERLAP = '{a}.doc = {b}.doc AND {a}.type = {b}.type AND ({a}.text = \'\') = ({b}.text = \'\') AND {a}."start" < {b}."end" AND {b}."start" < {a}."end"'


def per_doc_sql(on: str) -> str:
    cols = ", ".join(f'"{c}"' for c in on.split())
    return f"""
per AS (
    SELECT doc, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS tp, sum(coalesce(p.n, 0)) AS np, sum(coalesce(g.n, 0)) AS ng
    FROM (SELECT doc, {cols}, count(*) AS n FROM (SELECT DISTINCT doc, "start", "end", text FROM gold) GROUP BY ALL) g
    FULL JOIN (SELECT doc, {cols}, count(*) AS n FROM (SELECT DISTINCT doc, "start", "end", text FROM pred) GROUP BY ALL) p USING (doc, {cols})
    GROUP BY doc
), docs AS (SELECT doc, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn FROM per)"""


def pooled_sql(on: str) -> str:
    return f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, {per_doc_sql(on)}, sums AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM docs), rated AS ({PR} FROM sums)
SELECT tp, fp, fn, {RATES} FROM rated
"""


@query("g1_strict_overall", f"SELECT * FROM ({typed_sql(STRICT)}) WHERE type = 'overall'")
def g1(spark, d):
    return M.strict(B.gold(spark, d), B.pred(spark, d), by_type=False)


@query("g2_overlap_overall", f"SELECT * FROM ({typed_sql(OVERLAP)}) WHERE type = 'overall'")
def g2(spark, d):
    return M.overlap(B.gold(spark, d), B.pred(spark, d), by_type=False)


@query("g3_strict_by_type", typed_sql(STRICT))
def g3(spark, d):
    return M.strict(B.gold(spark, d), B.pred(spark, d))


@query("g3_overlap_by_type", typed_sql(OVERLAP))
def g3_overlap(spark, d):
    return M.overlap(B.gold(spark, d), B.pred(spark, d))


@query("f3_strict_matches", f"WITH {B.GOLD_SQL}, {B.PRED_SQL} SELECT p.* FROM pred p WHERE EXISTS (SELECT 1 FROM gold g WHERE {STRICT.format(a='p', b='g')})")
def f3(spark, d):
    return B.pred(spark, d).join(B.gold(spark, d), [*M.SPAN, "text"], "left_semi").select(*M.SPAN[:3], "type", "text")


@query("f4_overlap_misses", f"WITH {B.GOLD_SQL}, {B.PRED_SQL} SELECT g.* FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE {OVERLAP.format(a='g', b='p')})")
def f4(spark, d):
    return M.overlapping(B.gold(spark, d), B.pred(spark, d), "left_anti")


@query(
    "f7_conflicts",
    f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, g AS (SELECT DISTINCT doc, "start" AS s, "end" AS e, type AS t FROM gold), p AS (SELECT DISTINCT doc, "start" AS s, "end" AS e, type AS t FROM pred)
SELECT doc, 'start' AS place, g.s AS at, concat_ws(',', g.s, g.e, g.t) AS gold, concat_ws(',', p.s, p.e, p.t) AS pred FROM g JOIN p USING (doc) WHERE g.s = p.s AND (g.e <> p.e OR g.t <> p.t)
UNION ALL
SELECT doc, 'end', g.e, concat_ws(',', g.s, g.e, g.t), concat_ws(',', p.s, p.e, p.t) FROM g JOIN p USING (doc) WHERE g.e = p.e AND (g.s <> p.s OR g.t <> p.t)
""",
)
def f7(spark, d):
    return M.conflicts(B.gold(spark, d), B.pred(spark, d))


@query("g4_position", pooled_sql("start end"))
def g4(spark, d):
    return M.evaluate(B.gold(spark, d), B.pred(spark, d), mode="untyped", method="position")


@query("g4_text_exact", pooled_sql("text"))
def g4_text(spark, d):
    return M.evaluate(B.gold(spark, d), B.pred(spark, d), mode="untyped", method="text")


@query("g5_text_overlap")
def g5(spark, d):
    return M.evaluate(B.gold(spark, d), B.pred(spark, d), mode="untyped", method="text", text_mode="overlap")


@query("g5_text_similarity")
def g5_similar(spark, d):
    return M.evaluate(B.gold(spark, d), B.pred(spark, d), mode="untyped", method="text", text_mode="similarity", threshold=0.6)


@query(
    "g7_macro_average",
    f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, {per_doc_sql("start end")}, rated AS ({PR} FROM docs WHERE tp + fp + fn > 0)
SELECT count(*) AS docs, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1
FROM rated
""",
)
def g7(spark, d):
    return M.averaged(M.one_to_one(B.gold(spark, d), B.pred(spark, d), ["start", "end"]))


# Gold and predicted spans by key: the key of an entity is its document, line and type.
KEYED_SQL = f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, gk AS (
    SELECT doc, type AS key, min(struct_pack(s := "start", e := "end", t := text)) AS g FROM gold GROUP BY ALL
), pk AS (SELECT doc, type AS key, min(struct_pack(s := "start", e := "end", t := text)) AS p FROM pred GROUP BY ALL
), pairs AS (SELECT doc, key, g.s AS gs, g.e AS ge, g.t AS gt, p.s AS ps, p.e AS pe, p.t AS pt FROM gk FULL JOIN pk USING (doc, key))"""


def keyed(spark, d):
    """One gold and one predicted span of each (doc, key): the first; null where a side lacks the key."""
    first = lambda rows, n: rows.groupBy("doc", F.col("type").alias("key")).agg(F.min(F.struct("start", "end", "text")).alias(n))
    both = first(B.gold(spark, d), "g").join(first(B.pred(spark, d), "p"), ["doc", "key"], "full")
    cols = [F.col(f"{s}.{c}").alias(f"{s}{c[0]}") for s in "gp" for c in ("start", "end", "text")]
    return both.select("doc", "key", *cols)


@query("f2_align_union", f"{KEYED_SQL} SELECT * FROM pairs")
def f2(spark, d):
    return keyed(spark, d)


@query("f2_align_gold", f"{KEYED_SQL} SELECT * FROM pairs WHERE gs IS NOT NULL")
def f2_gold(spark, d):
    return keyed(spark, d).filter("gs is not null")


def tolerant(rows, ok):
    """Per-document counts where a span counts as right if ``ok``."""
    hit = F.coalesce(ok, F.lit(False))
    has = lambda c: F.col(c).isNotNull()
    sums = {"tp": has("gs") & has("ps") & hit, "fp": has("ps") & ~(has("gs") & hit), "fn": has("gs") & ~(has("ps") & hit)}
    return rows.groupBy("doc").agg(*(F.sum(c.cast("long")).alias(n) for n, c in sums.items()))


def tolerant_sql(ok: str) -> str:
    return f"""{KEYED_SQL}, flagged AS (SELECT *, coalesce({ok}, FALSE) AS hit FROM pairs), docs AS (
    SELECT doc, sum((gs IS NOT NULL AND ps IS NOT NULL AND hit)::INT) AS tp, sum((ps IS NOT NULL AND NOT (gs IS NOT NULL AND hit))::INT) AS fp, sum((gs IS NOT NULL AND NOT (ps IS NOT NULL AND hit))::INT) AS fn
    FROM flagged GROUP BY doc
), rated AS ({PR} FROM docs WHERE tp + fp + fn > 0)
SELECT count(*) AS docs, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1
FROM rated"""


@query("g8_boundary_tolerant", tolerant_sql("greatest(abs(gs - ps), abs(ge - pe)) <= 3"))
def g8(spark, d):
    return M.averaged(tolerant(keyed(spark, d), F.greatest(F.abs(F.col("gs") - F.col("ps")), F.abs(F.col("ge") - F.col("pe"))) <= 3))


@query("g9_coverage_tolerant", tolerant_sql("gt = pt OR (gt <> '' AND pt <> '' AND (contains(gt, pt) OR contains(pt, gt)) AND least(length(gt), length(pt)) / greatest(length(gt), length(pt)) >= 0.85)"))
def g9(spark, d):
    g, p = F.col("gt"), F.col("pt")
    ratio = F.least(F.length(g), F.length(p)) / F.greatest(F.length(g), F.length(p))
    covered = F.when((g != "") & (p != ""), (F.contains(g, p) | F.contains(p, g)) & (ratio >= 0.85)).otherwise(F.lit(False))
    return M.averaged(tolerant(keyed(spark, d), (g == p) | covered))


@query("g11_boundary_deltas", f"{KEYED_SQL} SELECT ps - gs AS start_delta, pe - ge AS end_delta, count(*) AS n FROM pairs WHERE gs IS NOT NULL AND ps IS NOT NULL GROUP BY ALL")
def g11(spark, d):
    rows = keyed(spark, d).filter("gs is not null and ps is not null")
    return rows.groupBy((F.col("ps") - F.col("gs")).alias("start_delta"), (F.col("pe") - F.col("ge")).alias("end_delta")).agg(F.count("*").alias("n"))


MISMATCH = "CASE WHEN gs IS NULL OR ps IS NULL THEN 'missing' WHEN gt = pt AND gs = ps AND ge = pe THEN 'equal' WHEN gt <> '' AND pt <> '' AND (contains(gt, pt) OR contains(pt, gt)) THEN 'substr' WHEN greatest(abs(gs - ps), abs(ge - pe)) <= 1 THEN 'edge1' ELSE 'other' END"


@query("g12_mismatch_classes", f"{KEYED_SQL} SELECT key, {MISMATCH} AS class, count(*) AS n FROM pairs GROUP BY ALL")
def g12(spark, d):
    g, p = F.col("gt"), F.col("pt")
    kind = (
        F.when(F.col("gs").isNull() | F.col("ps").isNull(), "missing")
        .when((g == p) & (F.col("gs") == F.col("ps")) & (F.col("ge") == F.col("pe")), "equal")
        .when(F.when((g != "") & (p != ""), F.contains(g, p) | F.contains(p, g)).otherwise(F.lit(False)), "substr")
        .when(F.greatest(F.abs(F.col("gs") - F.col("ps")), F.abs(F.col("ge") - F.col("pe"))) <= 1, "edge1").otherwise("other")
    )
    return keyed(spark, d).groupBy("key", kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "g13_error_samples",
    f"""
WITH {B.GOLD_SQL}, {B.PRED_SQL}, {per_doc_sql("start end")}, rated AS ({PR} FROM docs), bad AS (
    SELECT doc FROM rated WHERE CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END < 0.5
), g AS (SELECT DISTINCT doc, "start" AS s, "end" AS e, text AS t FROM gold), p AS (SELECT DISTINCT doc, "start" AS s, "end" AS e, text AS t FROM pred)
SELECT doc, 'missed' AS side, s AS "start", e AS "end", t AS text FROM (SELECT * FROM g EXCEPT SELECT * FROM p) WHERE doc IN (SELECT doc FROM bad)
UNION ALL
SELECT doc, 'extra', s, e, t FROM (SELECT * FROM p EXCEPT SELECT * FROM g) WHERE doc IN (SELECT doc FROM bad)
""",
)
def g13(spark, d):
    g, p = M.untyped(B.gold(spark, d)), M.untyped(B.pred(spark, d))
    per = M.one_to_one(g, p, ["start", "end"])
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    bad = per.filter(f1 < 0.5).select("doc")
    cols = ["doc", "start", "end", "text"]
    out = [a.join(b, cols, "left_anti").join(bad, "doc", "left_semi").select("doc", F.lit(n).alias("side"), *cols[1:]) for a, b, n in ((g, p, "missed"), (p, g, "extra"))]
    return out[0].unionByName(out[1])


@query(
    "g22_span_quality",
    f"""{KEYED_SQL}, pairs2 AS (SELECT *, greatest(least(ge, pe) - greatest(gs, ps), 0) AS inter FROM pairs WHERE gs IS NOT NULL AND ps IS NOT NULL)
SELECT count(*) AS n, round(avg((gs = ps AND ge = pe)::INT), 6) AS em, round(avg(CASE WHEN ge - gs + pe - ps > 0 THEN 2 * inter / (ge - gs + pe - ps) ELSE 0 END), 6) AS overlap_f1,
       round(avg((abs(gs - ps) <= 2 AND abs(ge - pe) <= 2)::INT), 6) AS near FROM pairs2""",
)
def g22(spark, d):
    rows = keyed(spark, d).filter("gs is not null and ps is not null")
    inter = F.greatest(F.least("ge", "pe") - F.greatest("gs", "ps"), F.lit(0))
    total = F.col("ge") - F.col("gs") + F.col("pe") - F.col("ps")
    same = (F.col("gs") == F.col("ps")) & (F.col("ge") == F.col("pe"))
    near = (F.abs(F.col("gs") - F.col("ps")) <= 2) & (F.abs(F.col("ge") - F.col("pe")) <= 2)
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(F.count("*").alias("n"), mean(same.cast("int")).alias("em"), mean(F.when(total > 0, 2 * inter / total).otherwise(0.0)).alias("overlap_f1"), mean(near.cast("int")).alias("near"))
