"""Queries of key curricula and of grids of window sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curriculum as R
from ..operators import grid as G
from . import bindings as B
from .registry import query

RATIOS, START, SEED = (0.3, 0.5, 0.25, 1.0), 12, 5
CURRICULUM_SQL = f"""{B.KEYS_SQL}, one AS (SELECT DISTINCT key FROM keys WHERE key LIKE '%e%'
), p AS (SELECT key, row_number() OVER (ORDER BY md5('{SEED}:' || key), key) AS place, count(*) OVER () AS total FROM one
), ratios(i, t) AS (VALUES {", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(RATIOS))}
), edges AS (SELECT 0 AS i, least({START}, (SELECT count(*) FROM one))::BIGINT AS n UNION ALL
    SELECT i + 1, n + CASE WHEN total - n = 0 OR t <= 0 THEN 0 WHEN t >= 1 THEN total - n ELSE least(greatest(ceil(t / (1 - t) * n), 1), total - n) END::BIGINT FROM edges JOIN ratios USING (i), (SELECT count(*) AS total FROM one)
), curriculum AS (SELECT title, key, (SELECT min(i) FROM edges WHERE n >= place)::INT AS round FROM keys JOIN p USING (key))"""


def curriculum(spark, d):
    return R.key_curriculum(B.keys(spark, d).filter("key like '%e%'"), START, RATIOS, SEED)


@query("h9_key_curriculum", f"WITH RECURSIVE {CURRICULUM_SQL} SELECT title, key, round FROM curriculum")
def h9_keys(spark, d):
    return curriculum(spark, d)


CHOSEN_SQL = f"""{CURRICULUM_SQL}, {B.RECORDS_SQL}, fields AS (SELECT r.id, r.title, r.key, r.value, c.round FROM records r JOIN curriculum c ON r.title = c.title AND r.key = c.key WHERE c.round IS NOT NULL
), per AS (SELECT id, title, min(round) AS first, list(DISTINCT round) AS own FROM fields GROUP BY ALL
), x AS (SELECT id, title, round, first < round AS has_prev, list_contains(own, round) AS has_new FROM (SELECT *, unnest(range(first, 4))::INT AS round FROM per)
), y AS (SELECT *, row_number() OVER (PARTITION BY round, has_new ORDER BY md5('9:' || round || ':' || id || ':' || title), id, title) AS place, count(*) OVER (PARTITION BY round, has_new) AS total FROM x
), z AS (SELECT *, has_new AND place <= greatest(1, ceil(total * 0.5::DOUBLE)) AS picked FROM y
), k AS (SELECT round, title, count(*) AS t FROM z WHERE has_prev OR picked GROUP BY ALL)"""


@query("h9_curriculum_records", f"WITH RECURSIVE {CHOSEN_SQL} SELECT z.round, z.id, z.title, f.key, f.value FROM z JOIN k ON z.round = k.round AND z.title = k.title AND t >= 3 JOIN fields f ON f.id = z.id AND f.title = z.title AND f.round <= z.round WHERE has_prev OR picked")
def h9_records(spark, d):
    return R.curriculum_records(B.records(spark, d), curriculum(spark, d), 3, 0.5, 3, 9)


@query("g25_curriculum_statistics", f"""WITH RECURSIVE {CHOSEN_SQL}, u AS (SELECT key, min(round) AS round FROM curriculum WHERE round IS NOT NULL GROUP BY key), a AS (SELECT r AS round, count(*) FILTER (u.round < r) AS keys_prev, count(*) FILTER (u.round = r) AS keys_new FROM range(4) g(r), u GROUP BY r
), s AS (SELECT round, count(*) FILTER (has_prev) AS prev_candidates, count(*) FILTER (has_new) AS new_candidates, count(*) FILTER (picked) AS new_selected, count(*) FILTER (has_prev OR picked) AS before_filter FROM z GROUP BY round
), t AS (SELECT round, coalesce(sum(t) FILTER (t >= 3), 0)::BIGINT AS after_filter, count(*) FILTER (t >= 3) AS titles_kept, count(*) FILTER (t < 3) AS titles_dropped FROM k GROUP BY round)
SELECT round::INT AS round, keys_prev, keys_new, round(keys_new / (keys_prev + keys_new), 6) AS new_ratio, prev_candidates, new_candidates, new_selected, before_filter, after_filter, titles_kept, titles_dropped FROM a JOIN s USING (round) JOIN t USING (round)""")
def g25_statistics(spark, d):
    return R.curriculum_statistics(B.records(spark, d), curriculum(spark, d), 3, 0.5, 3, 9)


GRID = ((64, 0), (64, 16), (48, 8), (200, 60), (1000, 10))


@query("g23_grid_scores", f"""WITH {B.GOLD_SQL}, {B.PRED_SQL}, n AS (SELECT doc, max("end") + 20 AS n FROM gold GROUP BY doc), g(size, overlap) AS (VALUES {", ".join(map(str, GRID))}
), c AS (SELECT DISTINCT size, overlap, doc, type, greatest("start", i * (size - overlap)) AS s, least("end", n, i * (size - overlap) + size) AS e FROM (SELECT p.*, n, size, overlap, unnest(CASE WHEN n <= size THEN [0] ELSE range(0, ceil((n - overlap) / (size - overlap))::BIGINT) END) AS i FROM pred p JOIN n USING (doc), g) WHERE "end" > "start" AND "start" < n AND i * (size - overlap) < least("end", n) AND i * (size - overlap) + size > "start"
), l AS (SELECT size, overlap, doc, list({{'s': s, 'e': e, 'type': type}} ORDER BY s, e, type) AS xs FROM c GROUP BY ALL
), f AS (SELECT size, overlap, doc, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN a[-1].type = b[1].type AND b[1].s <= a[-1].e + 1 THEN list_append(a[:-2], {{'s': a[-1].s, 'e': greatest(a[-1].e, b[1].e), 'type': b[1].type}}) ELSE a || b END)) AS m FROM l
), t AS (SELECT DISTINCT doc, type, "start"::BIGINT AS s, "end"::BIGINT AS e FROM gold), r AS (SELECT size, overlap, count(*) AS made, count(t.doc) AS tp FROM f LEFT JOIN t ON t.doc = f.doc AND t.type = m.type AND t.s = m.s AND t.e = m.e GROUP BY ALL
), w AS (SELECT size, overlap, sum(CASE WHEN n <= size THEN 1 ELSE ceil((n - overlap) / (size - overlap)) END)::BIGINT AS windows FROM n, g GROUP BY ALL
), q AS (SELECT size, overlap, windows, tp, made - tp AS fp, (SELECT count(*) FROM t) - tp AS fn FROM r JOIN w USING (size, overlap)
), v AS (SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM q)
SELECT row_number() OVER (ORDER BY f1 DESC, size, overlap)::INT AS rank, * FROM v""")
def g23_scores(spark, d):
    gold = B.gold(spark, d)
    lengths = gold.groupBy("doc").agg((F.max("end") + 20).alias("n"))
    return G.grid_scores(lengths, gold, B.pred(spark, d), GRID, 1)
