"""Key curricula and window grids against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanlake.operators import curriculum as R
from spanlake.operators import grid as G

chance = lambda *parts: hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def brute_rounds(structure, start, ratios, seed):
    keys = sorted({k for _, k in structure}, key=lambda k: (chance(seed, k), k))
    edges = [min(start, len(keys))]
    for t in ratios:
        left = len(keys) - edges[-1]
        more = 0 if not left or t <= 0 else left if t >= 1 else max(1, min(math.ceil(t / (1 - t) * edges[-1]), left))
        edges.append(edges[-1] + more)
    return {k: next((r for r, e in enumerate(edges) if i < e), None) for i, k in enumerate(keys)}


@pytest.mark.parametrize("start, ratios", [(3, (0.5, 0.2)), (0, (0.5, 0.5)), (1, (0.0, 0.9, 1.0)), (500, (0.3,)), (7, ())])
def test_rounds_depend_on_the_rounds_before(spark, start, ratios):
    structure = [(f"t{i % 4}", f"k{i * 7 % 61}") for i in range(150)]
    want = brute_rounds(structure, start, ratios, 3)
    rows = R.key_curriculum(spark.createDataFrame([(*r, 1) for r in structure], "title string, key string, place int"), start, ratios, 3).collect()
    assert {(r.title, r.key, r.round) for r in rows} == {(t, k, want[k]) for t, k in structure}
    assert R.key_curriculum(spark.createDataFrame([], "title string, key string"), start, ratios, 3).collect() == []


def test_safe_start_share():
    assert R.safe_start_share([0.5, 0.2]) == pytest.approx(0.4) and R.safe_start_share([1.0, 0.1]) == 0 and R.safe_start_share([]) == 1


def brute_records(records, of, rounds, share, least, seed):
    out, stats = set(), {}
    values = defaultdict(dict)
    for i, t, k, v in records:
        if t and t.strip():
            values[i, t][k] = v
    for r in range(rounds + 1):
        filled = {rec: {of[k] for k, v in f.items() if of.get(k) is not None and v is not None and v.strip()} for rec, f in values.items()}
        prev = {rec for rec, x in filled.items() if any(y < r for y in x)}
        new = sorted((rec for rec, x in filled.items() if r in x), key=lambda rec: (chance(seed, r, *rec), rec))
        picked = set(new if share >= 1 else new[: max(1, math.ceil(len(new) * share))])
        taken = prev | picked
        sizes = Counter(t for _, t in taken)
        kept = {rec for rec in taken if sizes[rec[1]] >= least}
        out |= {(r, *rec, k, v) for rec in kept for k, v in values[rec].items() if of.get(k) is not None and of[k] <= r and v not in (None, "")}
        before, fresh = (sum(test(x) for x in of.values() if x is not None) for test in (lambda x: x < r, lambda x: x == r))
        stats[r] = (before, fresh, round(fresh / (before + fresh), 6) if before + fresh else 0.0, len(prev), len(new), len(picked), len(taken), len(kept), sum(c >= least for c in sizes.values()), sum(c < least for c in sizes.values()))
    return out, stats


@pytest.mark.parametrize("share, least", [(1.0, 2), (0.4, 3), (0.01, 1)])
def test_records_of_rounds_equal_plain_python(spark, share, least):
    rnd = random.Random(6)
    structure = [(t, f"k{i}") for t in "abcd" for i in range(12)]
    of = brute_rounds(structure, 3, (0.4, 0.4), 1)
    records = [(i, rnd.choice(["a", "b", "c", "d", "", None]), f"k{k}", rnd.choice(["x", "", " ", None, "y z"])) for i in range(60) for k in rnd.sample(range(14), 4)]
    titles = {i: t for i, t, *_ in records}
    records = [(i, titles[i], k, v) for i, _, k, v in records]
    keys = R.key_curriculum(spark.createDataFrame(structure, "title string, key string"), 3, (0.4, 0.4), 1)
    frame = spark.createDataFrame([(*r, 5) for r in records], "id long, title string, key string, value string, round int").repartition(3)
    out, stats = brute_records(records, of, 2, share, least, 9)
    rows = [tuple(r) for r in R.curriculum_records(frame, keys, 2, share, least, 9).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == out
    assert {r[0]: tuple(r)[1:] for r in R.curriculum_statistics(frame, keys, 2, share, least, 9).collect()} == stats


def test_places_are_exact_within_groups(spark):
    rows = spark.range(5000).withColumn("g", F.col("id") % 3)
    out = R.placed(rows, F.md5(F.col("id").cast("string")), "g").collect()
    by = defaultdict(list)
    for r in out:
        by[r.g].append(r)
    for g, own in by.items():
        assert sorted(r.place for r in own) == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}
        assert [r.id for r in sorted(own, key=lambda r: r.place)] == sorted((r.id for r in own), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


@pytest.mark.parametrize("gap", [0, 2])
def test_grid_scores_equal_plain_python(spark, gap):
    rnd = random.Random(8)
    n = {doc: rnd.randrange(1, 90) for doc in range(30)}
    some = lambda: [(doc, s, s + rnd.randrange(1, 12), rnd.choice("AB")) for doc in n for s in rnd.sample(range(95), 6)]
    gold, pred = some(), some()
    pred += gold[::2] + [(0, 5, 5, "A"), (1, -1, 3, "B"), (77, 0, 4, "A")]
    points, want = ((16, 0), (16, 8), (40, 39), (200, 0), (16, 8)), []
    true = {g for g in gold if g[2] > g[1] >= 0}
    for size, overlap in dict.fromkeys(points):
        docs, windows = defaultdict(set), 0
        for doc, length in n.items():
            starts = [0] if length <= size else [i for i in range(0, length, size - overlap) if i == 0 or i + overlap < length]
            windows += len(starts)
            for d, s, e, t in pred:
                for a in starts:
                    if d == doc and e > s >= 0 and s < length and max(s, a) < min(e, length, a + size):
                        docs[doc].add((max(s, a), min(e, length, a + size), t))
        made = []
        for doc, spans in docs.items():
            own = []
            for s, e, t in sorted(spans):
                if own and own[-1][2] == t and s <= own[-1][1] + gap:
                    own[-1] = (own[-1][0], max(own[-1][1], e), t)
                else:
                    own.append((s, e, t))
            made += [(doc, *x) for x in own]
        tp = sum(m in true for m in made)
        p, r = tp / len(made), tp / len(true)
        want.append((size, overlap, windows, tp, len(made) - tp, len(true) - tp, round(p, 6), round(r, 6), round(2 * p * r / (p + r), 6) if tp else 0.0))
    want.sort(key=lambda x: (-x[-1], x[0], x[1]))
    frames = [spark.createDataFrame(x, "doc long, start int, end int, type string") for x in (gold, pred)]
    out = G.grid_scores(spark.createDataFrame(list(n.items()), "doc long, n int"), *frames, points, gap).orderBy("rank").collect()
    assert [tuple(r) for r in out] == [(i + 1, *w) for i, w in enumerate(want)]
    with pytest.raises(ValueError):
        G.clipped_to_windows(spark.createDataFrame(list(n.items()), "doc long, n int"), frames[1], [(8, 8)])


def test_grid_scores_make_no_rows_of_windows(spark):
    spans = spark.createDataFrame([(1, 0, 5, "A"), (1, 6, 9, None), (None, 0, 5, "A")], "doc long, start int, end int, type string")
    lengths = spark.createDataFrame([(1, 9), (2, None)], "doc long, n int")
    out = G.grid_scores(lengths, spans, spans, ((4, 0), (16, 2)))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r)[:7] for r in out.collect()] == [(1, 16, 2, 1, 1, 1, 2), (2, 4, 0, 3, 1, 2, 2)]
