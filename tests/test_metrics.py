"""Span metrics on small literals, and against an independent count."""

import random

import pytest

from spanlake.operators import metrics as M
from spanlake.operators import spans as S

SCHEMA = "doc long, start long, end long, type string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def overall(df):
    return next(r for r in df.collect() if r.type == "overall")


A = [(1, 0, 4, "P", "knee"), (1, 5, 9, "P", "pain"), (1, 12, 15, "D", "old")]


def test_perfect_and_none(spark):
    r = overall(M.strict(frame(spark, A), frame(spark, A)))
    assert (r.tp, r.fp, r.fn, r.f1) == (3, 0, 0, 1.0)
    r = overall(M.strict(frame(spark, A), frame(spark, [])))
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 0, 3, 0.0, 0.0, 0.0)


def test_adjacent_spans_do_not_overlap(spark):
    r = overall(M.overlap(frame(spark, [(1, 0, 4, "P", "a")]), frame(spark, [(1, 4, 8, "P", "b")])))
    assert (r.tp, r.fp, r.fn) == (0, 1, 1)


def test_overlap_counts_are_not_symmetric(spark):
    r = overall(M.overlap(frame(spark, [(1, 0, 10, "P", "a")]), frame(spark, [(1, 0, 4, "P", "b"), (1, 5, 9, "P", "c")])))
    assert (r.tp, r.fp, r.fn) == (2, 0, 0)


def test_entities_without_text_match_silently(spark):
    g, p = [(1, 0, 4, "P", "")], [(1, 0, 4, "P", ""), (1, 0, 4, "P", None), (1, 6, 8, "P", "")]
    r = overall(M.strict(frame(spark, g), frame(spark, p)))
    assert (r.tp, r.fp, r.fn) == (0, 1, 0)


def test_missing_fields_are_skipped(spark):
    r = M.pooled(M.one_to_one(frame(spark, A), frame(spark, [(1, None, 4, "P", "x"), (1, 0, 4, None, "knee")]), ["start", "end"])).first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 2)


def test_greedy_takes_each_gold_entity_once(spark):
    g, p = [(1, 0, 3, "P", "name"), (1, 9, 12, "P", "full name")], [(1, 0, 1, "P", "name"), (1, 2, 3, "P", "me"), (1, 4, 5, "P", "zz")]
    r = M.greedy(frame(spark, g), frame(spark, p), M.contains_either).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 0)
    assert M.similar(0.5)("abc", "abd") and not M.similar(0.6)("abc", "abd") and not M.similar(0.0001)("", "a")
    assert M.similar(0.8, {("big", "large"): 0.8})("large", "big")


def test_conflicts_and_arguments(spark):
    g, p = frame(spark, [(1, 0, 4, "P", "a")]), frame(spark, [(1, 0, 5, "P", "a")])
    assert M.conflicts(g, p).count() == 1
    with pytest.raises(ValueError):
        M.evaluate(g, p, validate=True)
    for bad in ({"mode": "x"}, {"method": "x"}, {"text_mode": "x"}, {"threshold": 2}):
        with pytest.raises(ValueError):
            M.evaluate(g, p, **bad)
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc int")
    assert M.evaluate(g, p, documents=(docs(1, 2), docs(2, 1))).count()
    with pytest.raises(ValueError):
        M.evaluate(g, p, documents=(docs(1), docs(1, 2)))


def decode(tags, char):
    """Spans of (label, mask, s, e) rows by a plain loop."""
    out, run = [], None
    for i, (label, mask, s, e) in enumerate(tags):
        if not mask or (char and e <= s):
            continue
        prefix, _, kind = label.partition("-")
        goes_on = prefix in "IE" and run is not None and run[0] == kind
        if not goes_on and run is not None:
            out.append((run[0], run[1], run[2] if char else i))
            run = None
        if prefix == "O":
            continue
        run = (kind, run[1] if goes_on else (s if char else i), e)
        if prefix == "E":
            out.append((kind, run[1], e if char else i + 1))
            run = None
    if run is not None:
        out.append((run[0], run[1], run[2] if char else len(tags)))
    return sorted(out)


def test_decoding_equals_a_loop(spark):
    rnd = random.Random(4)
    docs = {d: [(rnd.choice(["O", "B-X", "I-X", "E-X", "B-Y", "I-Y", "E-Y"]), rnd.random() > 0.2, i * 2, i * 2 + rnd.choice([0, 2, 2])) for i in range(rnd.randint(1, 14))] for d in range(60)}
    tags = spark.createDataFrame([(d, i, *t) for d, rows in docs.items() for i, t in enumerate(rows)], "doc long, idx int, label string, mask boolean, s int, e int").repartition(3)
    for char, f in ((False, S.token_spans), (True, S.char_spans)):
        got = {}
        for r in f(tags).collect():
            got.setdefault(r.doc, []).append((r.type, r.start, r.end))
        assert {d: sorted(x) for d, x in got.items()} == {d: decode(t, char) for d, t in docs.items() if decode(t, char)}


def test_gap_merge_stops_at_another_type(spark):
    rows = [(1, 0, 0, 0, 3, "P"), (1, 0, 0, 4, 6, "P"), (1, 0, 0, 7, 8, "D"), (1, 1, 5, 4, 6, "P"), (1, 1, 5, 0, 1, "P")]
    out = S.merge_chunks(spark.createDataFrame(rows, "doc long, chunk int, char_start long, start long, end long, type string"), gap=2).collect()
    assert sorted((r.type, r.start, r.end) for r in out) == [("D", 7, 8), ("P", 0, 6), ("P", 9, 11)]


def test_positions_meet_a_documents_tokens_as_a_list(spark):
    """No row is made for each pair of a position and a token: nothing is grouped behind the join."""
    from spanlake.operators import spans as S

    tokens = spark.createDataFrame([("a", i, 3 * i, 3 * i + 3) for i in range(5)] + [("b", 0, 0, 3), ("a", 9, 50, 50)], "doc string, idx int, s int, e int")
    places = S.char_to_token(spark.createDataFrame([("a", 4), ("a", 60), ("a", 60), ("c", 1), ("b", 3)], "doc string, pos int"), tokens)
    assert sorted(map(str, map(tuple, places.collect()))) == ["('a', 4, 1)", "('a', 60, 4)", "('b', 3, 0)", "('c', 1, None)"]
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
