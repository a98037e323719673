"""The n-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spanlake.llm import ngramjoin, sets
from spanlake.llm.ngramjoin import PARTS, _fits, prefix_length, rare_first, similar_groups

LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, n, component) of each row; rows of one id are one document."""
    sets = [grams(t) for _, t in rows]
    label = [i for i, _ in rows]
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in range(a):
                same_id = label[a] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
                if label[a] != label[b] and (same_id or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])):
                    label[a] = label[b] = min(x for x in (label[a], label[b]) if x is not None)
                    moved = True
    return Counter((i, len(s), c) for (i, _), s, c in zip(rows, sets, label, strict=True))


def result(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs).collect())


SHAPES = {"plain": {}, "blocks": {"BLOCK_ROWS": 2}, "one list": {"STAR_LISTS": 1, "PAIRS": 3}, "full filter": {}}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_equal_brute_force(docs, rows, shape, monkeypatch):
    for name, value in SHAPES[shape].items():
        monkeypatch.setattr(ngramjoin, name, value)
    if shape == "full filter":
        monkeypatch.setattr(sets, "FILTER_BITS", 64)
    assert result(docs) == brute([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("block", [2048, 4])
def test_groups_near_the_threshold(spark, block, monkeypatch):
    """Families whose members differ in some words each: chains, links just above and just below the threshold."""
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)
    rnd, rows = random.Random(11), []
    for family in range(6):
        base = [f"w{family}x{rnd.randrange(400)}" for _ in range(rnd.choice([12, 40, 90, 200]))]
        for _ in range(18):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                base = w  # a chain
            rows.append(" ".join(w[rnd.randrange(3) :]))
    footer = " ".join(f"footer{i}" for i in range(30))
    rows += [f"{' '.join(f'u{k}x{i}' for i in range(4))} {footer}" for k in range(25)]  # 27 of 34 n-grams shared: no link
    rows += rows[:9]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_ids_that_repeat_or_are_missing(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    rows = [(1, x), (5, x + " more"), (5, y), (8, y), (9, z), (9, None), (9, ""), (None, z), (None, "only here and nowhere else"), (None, None), (3, "one"), (4, "ONE"), (6, " \t")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, key string")
    assert result(docs) == brute(rows)


def test_long_texts_and_nothing(spark):
    words = [f"w{i % 7919}x{i % 104729}" for i in range(300_000)]
    rows = [(2, " ".join(words)), (1, " ".join(["start", *words])), (3, "w" * 2_000_000)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filters_keep_every_link():
    """Two sets that are similar enough share a prefix n-gram, and the filters let the first one pass."""
    rnd = np.random.default_rng(4)
    order = rnd.integers(0, 9, ngramjoin.BUCKETS).astype(np.uint16)
    seen = 0
    for _ in range(400):
        size = int(rnd.integers(1, 400))
        x = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64))
        y = np.unique(np.r_[x[rnd.random(len(x)) > rnd.random() * 0.12], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + size // 12)), dtype=np.uint64)])
        if not ngramjoin.similar(x, y):
            continue
        seen += 1
        px, py = (list(rare_first(s, order)[: prefix_length(len(s))]) for s in (x, y))
        first = next(g for g in px if g in py)
        parts = np.array([np.minimum(255, np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=PARTS)).astype(np.uint8) for s in (x, y)])
        assert _fits(np.array([0]), np.array([1]), np.array([len(x), len(y)]), np.array([px.index(first), py.index(first)]), parts).all()
    assert seen > 100


def test_families_that_nearly_link_meet_as_homes(spark, monkeypatch):
    """Two families of near copies pass the filters against each other, but aren't linked: their pairs aren't emitted."""
    rnd, counts = random.Random(2), []
    base = [f"w{rnd.randrange(10**6)}" for _ in range(1000)]
    other = [*base[:400], *(f"o{i}" for i in range(92)), *base[492:]]
    rows = []
    for family in (base, other):
        for _ in range(20):
            w = list(family)
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    found = ngramjoin.across
    monkeypatch.setattr(ngramjoin, "across", lambda *x: (out := found(*x), counts.append(out.count()))[0])
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert counts and counts[0] <= 20
