"""Merkle manifests and proofs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanlake.llm.manifest import build, folded, leaf_digest, proof_text, prove, verify
from spanlake.llm.tables import remainder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, place, node):
    """The siblings on the way, and what ``node`` folds to."""
    proof = ""
    for level in levels[:-1]:
        run, at = level[place // 16 * 16 : place // 16 * 16 + 16], place % 16
        proof += "".join(run[:at] + run[at + 1 :])
        node, place = sha("".join([*run[:at], node, *run[at + 1 :]])), place // 16
    return proof, node


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = {}, {}
    for s in names:
        own[s] = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in own[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, r in enumerate(own[s]):
            changed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
            claim = leaf((*r[:4], r[4].translate(LOWER) if changed and r[4] is not None else r[4]))
            low, node = climb(trees[s], place, claim)
            high, node = climb(top, k, node)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(low + high), node, node == top[-1][0]))
    return out


def rows_of(sizes):
    rnd = random.Random(3)
    rows = []
    for source, n in sizes:
        for _ in range(n):
            rows.append((rnd.randrange(10**6), source, rnd.choice(["en", "de", None]), rnd.choice([None, 7]), rnd.choice(["Alpha Beta", "alpha", "", None, "Ünï 中文 😀 A:1-"])))
    rnd.shuffle(rows)
    return rows


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", leaf string, place int, digest string").repartition(5)
    out = verify(spark, docs, remainder("doc_id", 5) == 0).withColumn("proof_sha256", F.sha2(proof_text(F.col("segments")), 256))
    return Counter(tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize(
    "sizes",
    [
        [("a", 1)],
        [("a", 16)],
        [("a", 1), ("b", 1)],
        [(None, 3), ("", 1), ("é", 17), ("z", 300)],
        [(f"s{i}", 1 + i % 3) for i in range(20)],
    ],
)
def test_manifest_equals_brute_force(spark, sizes):
    rows = rows_of(sizes)
    assert result(spark, rows) == Counter(brute(rows))


def test_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(5, "a", "en", 3, "Same"), (5, "a", "en", 3, "Same"), (None, "a", None, None, "No Id"), (None, None, None, None, None), (5, "a", "en", 3, "Other"), (10, "b", "en", 1, "Long " * 400_000)]
    assert result(spark, rows) == Counter(brute(rows))


def test_nothing(spark):
    assert result(spark, []) == Counter()


def test_proofs_of_some_leaves(spark):
    docs = spark.createDataFrame(rows_of([("a", 40), ("b", 5)]), SCHEMA)
    made = build(docs, ["doc_id", "text"], "source", "doc_id", key=F.col("doc_id"))
    wanted = made.leaves.filter("carried.key % 3 = 0")
    out = prove(spark, made, wanted).select("carried.key", "leaf", folded(F.col("leaf"), F.col("segments")).alias("root")).collect()
    assert {r.root for r in out} == {made.root}
    assert Counter(r.key for r in out) == Counter(r.doc_id for r in docs.filter("doc_id % 3 = 0").collect())
    # The store holds each inner node once, under the digest of its children.
    for r in made.store.collect():
        assert hashlib.sha256(bytes(r.children).hex().encode()).digest() == bytes(r.digest)


def test_leaf_tells_null_from_dash(spark):
    one = spark.range(1)
    a, b = one.select(F.hex(leaf_digest(F.lit(None), F.lit("-"))), F.hex(leaf_digest(F.lit("-"), F.lit(None)))).first()
    assert a != b
