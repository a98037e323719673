"""Coverage of aliases and values, and choices among fields."""

import pytest

from spanlake.operators import coverage as V
from spanlake.operators import spans as S

RECORD = "id long, ord long, title string, key string, value string"


@pytest.fixture
def records(spark):
    rows = [(1, 1, "A", "k1", "x  y"), (1, 2, "A", "k2", "gone"), (1, 3, "A", "k3", None), (2, 4, "A", "k1", ""), (3, 5, "B", "k9", "z")]
    return spark.createDataFrame(rows, RECORD)


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_alias_coverage_and_mismatches(spark, records):
    aliases = spark.createDataFrame([("A", "k1", "one", 1), ("A", "k1", "uno", 2), ("A", "k7", "seven", 3), ("C", "k1", "c", 4)], "title string, key string, alias string, ord int")
    plan = V.alias_plan(records, aliases)
    assert rows_of(plan, "id", "key", "shown") == [(1, "k1", "one"), (2, "k1", "uno")]
    out = {r.title: tuple(r)[1:] for r in V.alias_coverage(aliases, records, plan.filter("id = 1")).collect()}
    assert out == {"A": (3, 1, 2, 0.333333, 0.5, ["seven"]), "C": (1, 0, 0, 0.0, 1.0, ["c"])}
    reports = spark.createDataFrame([(1, "has one"), (2, None)], "id long, report string")
    assert rows_of(V.alias_mismatches(reports, plan), "id", "alias", "key") == [(2, "uno", "k1")]
    assert rows_of(V.alias_mismatches(reports.limit(0), plan), "id", "alias") == [(1, "one"), (2, "uno")]


def test_lost_values(spark, records):
    reports = spark.createDataFrame([(1, "k1：x\ny"), (3, None)], "id long, report string")
    out = {r.id: (r.total, [x.value for x in r.lost]) for r in V.lost_values(reports, records).collect()}
    assert out == {1: (2, ["gone"]), 2: (1, []), 3: (1, ["z"])}
    assert V.lost_values(reports, records.limit(0)).collect() == []


def test_selected_fields(spark, records):
    assert rows_of(V.selected_fields(records, "all", cap=2, exclude=["k1"]), "id", "key") == [(1, "k2"), (1, "k3"), (3, "k9")]
    assert rows_of(V.selected_fields(records, "custom", custom=["k3", "k1", "no"], cap=1), "id", "key") == [(1, "k3"), (2, "k1")]
    assert rows_of(V.selected_fields(records, "all", titles=["B"]), "id", "key") == [(3, "k9")]
    added = spark.createDataFrame([(1, "new", 1), (1, " ", 2), (8, "k1", 1)], "id long, key string, ord int")
    assert rows_of(V.selected_fields(records, "added", added), "id", "key") == [(1, "new")]
    with pytest.raises(ValueError):
        V.selected_fields(records, "none")


def test_perturbed_and_limited_keys(spark, records):
    structure = spark.createDataFrame([("A", f"k{i}", i) for i in range(1, 6)], "title string, key string, ord int")
    own = {(r.id, r.key) for r in records.collect()}
    same = V.perturbed(records, structure, 0.0, 0.0, 0, 1, 2)
    assert {(r.id, r.key) for r in same.collect() if r.variant == 2} == {x for x in own if x[0] < 3}
    assert {(r.id, r.key) for r in same.collect() if r.variant == 0} == own
    all_ = [r for r in V.perturbed(records, structure, 0.0, 1.0, 0, 1).collect() if r.variant == 1]
    assert {(r.id, r.key) for r in all_} == {(i, f"k{k}") for i in (1, 2) for k in range(1, 6)}
    assert {r.value for r in all_ if (r.id, r.key) not in own} == {""}
    few = [r for r in V.perturbed(records, structure, 1.0, 0.0, 3, 1).collect() if r.variant == 1]
    assert [sum(r.id == i for r in few) for i in (1, 2)] == [3, 3] and {r.value for r in few} == {""}
    keys = records.select("id", "title", "key", "ord")
    assert rows_of(V.limited_keys(keys, 1), "id", "key") == [(1, "k1"), (2, "k1"), (3, "k9")]
    assert V.limited_keys(keys, 0).count() == 5 and V.limited_keys(keys, 2, "random", 3).count() == 4


def test_flags_and_key_sets(spark):
    scored = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.6), (1, "c", None)], "id long, option string, prob double")
    assert rows_of(V.option_flags(scored).filter("flag"), "option") == [("b",)]
    a, b = (spark.createDataFrame(x, "title string, key string") for x in ([("t", "x"), ("t", "y")], [("t", "y"), ("u", "y")]))
    assert [V.key_sets(a, b, h).count() for h in ("union", "intersection", "difference")] == [3, 1, 1]


def test_answers_by_quality_and_mean_null(spark):
    rows = [
        (1, 0, 0, 2, 5.0, 1.0, "姓名：甲"), (1, 1, 3, 5, 4.5, 1.0, "正常值"),  # the name of a field costs more than the lead
        (2, 0, 0, 2, 5.0, 1.0, "姓名：甲"), (2, 1, 3, 5, 3.0, 1.0, "正常值"),  # a clear lead
        (3, 0, 0, 2, 5.0, 0.0, "正常"), (3, 1, 3, 5, 5.0, 0.0, "甲"), (3, 2, 6, 9, 5.0, -1.0, "正常值"),  # a higher lead over null
        (4, 0, 0, 1, 1.0, 9.0, None), (4, 1, 0, 0, 0.5, 2.0, ""),
    ]
    chunks = spark.createDataFrame(rows, 'doc long, chunk int, start int, end int, score double, null_score double, text string')
    assert rows_of(S.best_answer(chunks, 2, quality=True), "doc", "chunk", "no_answer") == [(1, 1, False), (2, 0, False), (3, 2, False), (4, 1, True)]
    assert rows_of(S.best_answer(chunks, 4, "mean"), "doc", "chunk", "null_score", "no_answer")[3] == (4, 0, 5.5, True)
    with pytest.raises(ValueError):
        S.best_answer(chunks, 2, "sum")


def test_perturbed_moves_no_row_for_each_key_of_a_title(spark):
    """A title's keys meet a record as a list: the plan's only join is on titles, with one row for each."""
    structure = spark.createDataFrame([("A", f"s{i}") for i in range(50)] + [("A", None)], "title string, key string")
    some = spark.createDataFrame([(i, i, "A", "k", "v") for i in range(40)] + [(None, 99, "A", "k", "v"), (77, 1, None, "k", "v")], RECORD)
    out = V.perturbed(some, structure, 1.0, 0.0, 4, 3, 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "variant" not in plan[plan.index("Join") :]
    rows = out.collect()
    assert sum(r.variant == 0 for r in rows) == 42
    for i in range(40):
        assert [sum(r.id == i and r.variant == v for r in rows) for v in (1, 2)] == [4, 4]
    assert not [r for r in rows if r.variant and (r.id in (None, 77) or r.key is None)]


def test_missing_keys_are_told_within_a_row(spark):
    from spanlake.operators import keys as K

    structure = spark.createDataFrame([("A", "k1"), ("A", "k2"), ("A", "k2"), ("A", None), ("B", "k1")], "title string, key string")
    some = spark.createDataFrame([(1, 1, "A", "k1", "v"), (2, 2, "B", "k1", "v"), (3, 3, "A", None, "v"), (4, 4, "C", "k", "v")], RECORD)
    out = K.missing_keys(some, structure)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "A", "k2"), (1, "A", None), (3, "A", "k1"), (3, "A", "k2")]))
