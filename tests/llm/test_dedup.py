"""Near duplicates and repeated passages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from spanlake.llm import neardup
from spanlake.llm.neardup import near_duplicates
from spanlake.llm.repeats import previous_factors, remove_repeats

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        sets[i] = shingles(t)
    group = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    moved = True
    return sets, group


def test_components_equal_brute_force(docs, rows, monkeypatch):
    sets, group = brute_components(rows)
    for block in (2048, 2):  # 2: buckets are dealt into blocks
        monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
        monkeypatch.setattr(neardup, "HOME_ROWS", block)
        out = near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == Counter((i, len(sets[i]), group[i], i == group[i]) for i, *_ in rows)


def test_near_duplicates_of_nothing(no_docs, spark):
    assert near_duplicates(no_docs).collect() == []
    out = near_duplicates(spark.createDataFrame([(None, None), (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert [r.component_id for r in out] == [None, None]


def test_rows_of_one_id_are_one_document(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(40)) for k in "xyz")
    docs = spark.createDataFrame([(1, x), (5, x + " more"), (5, y), (8, y), (9, z), (9, None), (None, z)], "doc_id long, text string").repartition(3)
    out = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert out == {(1, 1, True), (5, 1, False), (8, 1, False), (9, 9, True), (None, 9, False)}
    own = docs.withColumn("nr", F.monotonically_increasing_id())
    out = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(own, row="nr").collect()}
    assert out == {(1, 1, True), (5, 1, False), (5, 5, True), (8, 5, False), (9, 9, True), (None, 9, False)}


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    """A group of copies with other edits each, unlike texts around a common start, and exact copies; in blocks of 3."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 5
    for _ in range(25):
        w = base.copy()
        for k in rnd.sample(range(60), rnd.randint(1, 4)):
            w[k] = f"e{rnd.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:12] + [f"u{k}_{i}" for i in range(12)]) for k in range(20)]
    texts += [" ".join(base[:30] + [f"v{k % 3}_{i}" for i in range(20)] + [f"{k}"]) for k in range(12)]
    rows = list(enumerate(texts))
    sets, group = brute_components(rows)
    for block in (2048, 3):
        monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
        monkeypatch.setattr(neardup, "HOME_ROWS", block)
        out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {r.doc_id: r.component_id for r in out} == group


def test_thresholds_miss_almost_nothing():
    """At a similarity of 0.75 a symbol differs with probability 1/4."""
    tail = lambda n, d: sum(math.comb(n, k) * 3 ** (n - k) for k in range(d + 1, n + 1)) / 4**n
    assert tail(neardup.SYMBOLS, neardup.DISTANCE) + tail(neardup.SYMBOLS + neardup.FURTHER, neardup.SYMBOLS + neardup.FURTHER - neardup.AGREE) < 1e-6
    assert neardup.DISTANCE < 2 * neardup.SYMBOLS // neardup.CHUNK  # pigeonhole: a chunk with one error at most


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: r[0]):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def test_repeats_equal_brute_force(docs, rows):
    got = remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows)
    assert any(r.n_removed for r in got)


def test_repeats_of_nothing(no_docs, spark):
    assert remove_repeats(no_docs).collect() == []
    r = remove_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0]
    assert (r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) == (None, 0, 0, b"")


@settings(max_examples=40, deadline=None)
@given(st.text("ab", min_size=12, max_size=80), st.integers(9, 40))
def test_previous_factors(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    places = np.arange(max(0, len(text) - length + 1))
    got = previous_factors(data, places, length)
    assert got.tolist() == [any(text[j : j + length] == text[i : i + length] for j in range(i)) for i in places.tolist()]


def test_sha_of_kept_bytes_is_of_whole_text_without_repeats(spark):
    r = remove_repeats(spark.createDataFrame([(1, "short")], "doc_id long, text string")).collect()[0]
    assert hashlib.sha256(bytes(r.kept)).hexdigest() == hashlib.sha256(b"short").hexdigest()
