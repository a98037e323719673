"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import pytest

from spanlake.llm import lexical
from spanlake.llm.lexical import search

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, n in bags:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort()
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(scored[:k])]
    return Counter(out)


ITEMS = [
    (1, "stoneriver WINDHILL rainmarket"),
    (2, "nothing at all to be found: zzz"),
    (3, None),
    (4, "..."),
    (5, "Ünïcödé “quotes” — 中文 😀 œuvre"),
    (5, "der die das"),
    (None, "the of and newmill"),
    (7, "one two one two"),
    (8, "snowtower lightvalley darkforest oldisland newstation stoneriver windhill"),
]
SHAPES = {"plain": {}, "blocks": {"ENTRIES": 8}, "slices": {"COLUMNS": 2}, "dense": {"DENSE": 1}, "sparse": {"DENSE": 99}}


@pytest.mark.parametrize("shape", SHAPES)
def test_search_equals_brute_force(spark, docs, rows, shape, monkeypatch):
    for name, value in SHAPES[shape].items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, doc_id int, term string")
    out = Counter(tuple(r) for r in search(docs, items, 3).collect())
    assert out == brute([(i, t) for i, t, _ in rows], ITEMS, 3)


def test_ties_classes_and_null_ids(spark):
    texts = [(i, "alpha beta beta, gamma!") for i in range(40, 0, -1)] + [(None, "Gamma beta alpha beta"), (99, "alpha delta delta epsilon"), (98, "alpha epsilon delta delta other other"), (50, "alpha beta beta gamma"), (50, "beta alpha beta gamma"), (7, "unrelated")]
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for k in (3, 60):
        out = Counter(tuple(r) for r in search(docs, spark.createDataFrame(items, "item_id long, text string"), k).collect())
        assert out == brute(texts, items, k)


def test_weights_beyond_doubles_are_added_as_integers():
    import numpy as np

    for weights in (np.array([3, 5, 7]), np.array([2**40, 3, 2**40 + 1])):
        item, term = np.array([0, 0, 1]), np.array([0, 2, 1])
        scorer = lexical.Scorer(item, term, weights, 2)
        row, entries, m = np.array([0, 0, 1]), np.array([[0, 1], [2, 4], [1, 2]]), np.array([10, 500])
        (_, out), = scorer.score(row, entries, m)
        part = lambda t, tf, m: int(weights[t]) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        assert out.tolist() == [[part(0, 1, 10) + part(2, 4, 10), 0], [0, part(1, 2, 500)]]


def test_long_texts_and_nothing(spark):
    texts = [(1, "rare " + "common word " * 500_000), (2, "common rare"), (3, "word")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), [(1, "rare common")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in search(docs, asked).collect()) == brute(texts, items, 10)
    assert search(docs.limit(0), asked).collect() == []
    assert search(docs, asked.limit(0)).collect() == []
