"""Splits, item separators, statistics and value lists against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.operators import splits as P


@pytest.mark.parametrize("n", [1, 2, 3, 10, 57])
def test_sizes_of_splits_are_exact(spark, n):
    rows = spark.range(n).withColumn("place", F.lit(1))
    count = lambda df: Counter(r.split for r in df.collect())
    assert count(P.eval_split(rows, "id", 0.1, 1)) == +Counter(eval=max(1, int(n * 0.1)), train=n - max(1, int(n * 0.1)))
    assert count(P.pool_split(rows, "id", 0.5, 1)) == +Counter(test=-(-n // 2), val=n // 2)
    out = P.three_way(rows, "id", 0.6, 0.2, 1).collect()
    m = max(n, 3)
    train = int(m * 0.6)
    val = int((m - train) * (0.2 / 0.4))
    assert Counter(r.split for r in out) == +Counter(train=train, val=val, test=m - train - val)
    assert {r.id for r in out} == set(range(n)) and sum(r.copy == 0 for r in out) == n


def test_splits_of_labelled_rows_and_bad_shares(spark):
    rows = spark.range(20)
    out = P.three_way(rows, "id", 0.5, 0.0, 1, F.col("id") % 2 == 0).collect()
    assert Counter(r.split for r in out) == {"train": 5, "test": 5} and all(r.id % 2 == 0 for r in out)
    assert P.three_way(rows.limit(0), "id", 0.5, 0.2, 1).collect() == []
    for train, val in ((0, 0.5), (0.5, -0.1), (0.6, 0.4)):
        with pytest.raises(ValueError):
            P.three_way(rows, "id", train, val, 1)


def test_each_run_of_four_has_all_separators(spark):
    rows = spark.range(50).select((F.col("id") % 3).alias("g"), "id")
    out = sorted((r.g, r.id, r.separator) for r in P.item_separators(rows, "g", "id", 2).collect())
    runs = [tuple(s for g, _, s in out if g == k)[i : i + 4] for k in range(3) for i in range(0, 16, 4)]
    assert all(len(r) < 4 or set(r) == set(P.ITEM_SEPARATORS) for r in runs) and len(set(runs)) > 3


def test_statistics_of_small_and_empty_sets(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "名 x"), (3, None), (4, "one two three four")], "doc long, text string")
    entities = spark.createDataFrame([(1, "KEY"), (1, "KEY"), (2, "VALUE"), (3, None)], "doc long, type string").filter("type is not null")
    (r,) = P.diagnosis(texts, entities, 2).collect()
    assert (r.rows, r.least, r.most, r.mean, r.median, r.cut_share) == (4, 0, 4, 2.2, 3, 0.5) or r.mean == 2.3
    assert r.types == {"KEY": 2, "VALUE": 1} and r.issues == ["few_values", "few_rows", "many_cut"]
    (r,) = P.diagnosis(texts.limit(0), entities.limit(0), 2).collect()
    assert r.rows == 0 and r.median is None and r.issues == ["few_rows"]
    records = spark.createDataFrame([(1, "k", "a b"), (1, "l", None)], "id long, key string, value string")
    reports = spark.createDataFrame([(1, "t", "x y z"), (2, "", None)], "id long, title string, report string")
    assert tuple(P.dataset_stats(records, reports).first()) == (2, 3, 2, 2, 1, 1.0)
    assert tuple(P.dataset_stats(records.limit(0), reports.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)


def test_value_lists_keep_keys_and_values_that_stand_alone(spark):
    spans = [(1, "VALUE", "early", 0, 2), (1, "KEY", "k", 3, 4), (1, "VALUE", "v1", 5, 6), (1, "KEY", "l", 7, 8), (1, "KEY", "k", 9, 10), (1, "VALUE", "v2", 11, 12), (1, "HOSPITAL", "h", 13, 14)]
    out = {r.key: r["values"] for r in P.value_lists(spark.createDataFrame(spans, "doc long, type string, text string, start int, end int")).collect()}
    assert out == {None: ["early"], "k": ["v1", "v2"], "l": []}
