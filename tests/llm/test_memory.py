"""What a worker holds: steps on texts of a shard or a batch, and codecs of tasks that are over."""

import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from spanlake.llm import bpe, neardup, repeats, tables


def peak(work, *args):
    tracemalloc.start()
    try:
        return work(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_ranking_suffixes_holds_few_copies():
    rnd = np.random.default_rng(3)
    base = rnd.integers(97, 123, 300).astype(np.uint8)
    text = np.concatenate([np.r_[base[: int(k)], rnd.integers(97, 123, 50).astype(np.uint8)] for k in rnd.integers(110, 300, 4000)])
    places = np.arange(len(text) - 100)
    found, most = peak(repeats.previous_factors, text, places, 100)
    seen, want = set(), []
    for p in places.tolist():
        x = text[p : p + 100].tobytes()
        want.append(x in seen)
        seen.add(x)
    assert found.tolist() == want
    assert most < 45 * len(text)  # 66 bytes of each place before


def test_cutting_a_batch_holds_few_copies():
    n = 1 << 20
    gone = np.zeros(n, bool)
    gone[1000:2000] = gone[n - 300 : n - 99] = True
    sizes = np.array([0, 3000, n - 3000])
    row = {"ids": repeats.pack(np.arange(3)), "nulls": repeats.pack(np.zeros(3, bool))}
    args = (row, np.full(n, 97, np.uint8), sizes, gone, 100)
    repeats._cut(*args)  # loads what libraries load late
    out, most = peak(repeats._cut, *args)
    assert out.column("n_removed").to_pylist() == [0, 1099, 300]
    assert out.column("spans").to_pylist() == [[], [{"first": 1000, "end": 2099}], [{"first": n - 3300, "end": n - 3000}]]
    assert most < 16 * n  # 31 bytes of each place before


def test_runs_may_be_empty():
    assert repeats._flat(np.array([5, 9, 2, 7]), np.array([0, 3, 0, 2])).tolist() == [9, 10, 11, 7, 8]
    assert repeats._flat(np.array([4]), np.array([0])).tolist() == []


def test_a_closed_codec_holds_nothing():
    codec = bpe.Codec([bytes([b]) for b in range(256)] + [b"ab"])
    assert codec.encode([b"abc"]) == [np.array([256, 99], "<u4").tobytes()]
    db = codec.db
    codec.close()
    assert not vars(codec)
    with pytest.raises(Exception, match="closed"):
        db.execute("SELECT 1")


def test_compacted_tables_have_few_files_and_all_rows(spark):
    """Numbers by partition stay unique; near duplicates wrote a file for each of 60 partitions before."""
    rows = spark.range(1000).repartition(60, "id").withColumn("number", F.monotonically_increasing_id())
    out = tables.compacted(rows)
    most = tables.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert len(out.inputFiles()) <= most < 60
    found = out.collect()
    assert {r.id for r in found} == set(range(1000)) and len({r.number for r in found}) == 1000


def test_near_duplicates_write_few_files(spark, monkeypatch):
    counts, write = [], tables.materialize

    def counted(df):
        out = write(df)
        counts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(tables, "materialize", counted)
    monkeypatch.setattr(neardup, "materialize", lambda df: write(df))  # large rows and those from Python
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = [f"w{i}" for i in range(60)]
        texts = [" ".join([*base[: 59 - k % 3], f"x{k}"]) for k in range(40)] + [f"alone{k} a b c d e f" for k in range(40)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(60)
        kept = [r.doc_id for r in neardup.near_duplicates(docs).filter("kept").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(kept) == [0, *range(40, 80)]
    assert len(counts) >= 8 and max(counts) <= tables.TASKS_A_CORE * spark.sparkContext.defaultParallelism
