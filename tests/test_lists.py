"""Spans of a text meet as lists in one row: results as by plain Python, and plans without pairs of rows."""

import random

from spanlake.operators import coverage as V
from spanlake.operators import metrics as M
from spanlake.operators import spans as S


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def some(spark):
    rnd = random.Random(5)
    ents = [(d, s, s + rnd.randrange(-1, 9), rnd.choice(["a", "b", None]), i) for d in (1, 2, 3, None) for i, s in enumerate(rnd.choices(range(-2, 25), k=8))]
    ents += [(1, None, 4, "a", 20), (2, 3, 5, "c", None), (9, 0, 4, "a", 0)]
    tokens = [(d, i, i * 3 - 3, i * 3 + (i % 4)) for d in (1, 2, 3, 4, None) for i in range(9)] + [(1, 9, None, 4)]
    lengths = [(1, 20), (2, 18), (3, 40), (4, 5), (None, 9)]
    frames = [spark.createDataFrame(x, s) for x, s in ((ents, "doc long, start long, end long, type string, ord int"), (tokens, "doc long, idx int, s int, e int"), (lengths, "doc long, length int"))]
    return ents, tokens, dict(lengths), frames


def test_labels_of_characters_and_tokens(spark):
    ents, tokens, lengths, (e, t, n) = some(spark)
    chars = {}
    for d, s, z, kind, at in ents:
        if d is None or d not in lengths:
            continue
        a, b = (max(0, lengths[d] if x is None else min(lengths[d], x)) for x in (s, z))
        for p in range(a, b):
            label = None if kind is None or at is None else ("E-" if p == b - 1 else "B-" if p == a else "I-") + kind.upper()
            key = -1 if at is None else at
            if (d, p) not in chars or key > chars[d, p][0]:
                chars[d, p] = (key, label)
    made = S.char_labels(e, n)
    assert {(r.doc, r.pos): r.label for r in made.collect()} == {k: v for k, (_, v) in chars.items()}
    assert "Join" not in plan(made) and "Generate" not in plan(made)
    raw = {}
    for d, i, s, z in tokens:
        own = [chars[d, p][1] or "" for p in range(s, z) if (d, p) in chars] if s is not None and d is not None else []
        of = lambda p: [x for x in own if x.startswith(p)]  # noqa: E731, B023
        raw[d, i] = (of("B-")[:1] or of("E-")[-1:] or of("I-")[:1] or ["O"])[0]
    want = {}
    for (d, i), x in raw.items():
        before = raw.get((d, i - 1), "O")
        want[d, i] = "B-" + x[2:] if x.startswith("I-") and (before == "O" or before.startswith("E-") or before[2:] != x[2:]) else x
    for out in (S.token_labels(t, made), S.entity_token_labels(t, e, n)):
        assert {(r.doc, r.idx): r.label for r in out.collect()} == want and "Join" not in plan(out)


def test_clips_merge_in_their_row(spark):
    e = some(spark)[3][0].drop("ord")
    c = spark.createDataFrame([(d, k, k * 6, k * 6 + 9) for d in (1, 2, 3, None) for k in range(4)], "doc long, chunk int, char_start int, char_end int")
    clips = S.clip(e, c)
    for gap in (None, 0, 2):
        apart = S.merge_chunks(clips.join(c.drop("char_end"), ["doc", "chunk"]), gap).select("doc", "type", "start", "end")
        one = S.merged_clips(e, c, gap)
        assert sorted(map(str, apart.collect())) == sorted(map(str, one.select("doc", "type", "start", "end").collect()))
        assert "Join" not in plan(one)
    assert "Join" not in plan(clips)


def test_character_spans_group_nothing(spark):
    tags = spark.createDataFrame([(1, i, x, i != 3, i * 2, i * 2 + 2) for i, x in enumerate(["B-A", "I-A", "O", "I-A", "I-B", "E-B", "B-A", "E-A", "E-A"])], "doc long, idx int, label string, mask boolean, s int, e int")
    out = S.char_spans(tags)
    assert sorted(map(tuple, out.collect())) == [(1, "A", 0, 4), (1, "A", 12, 16), (1, "A", 16, 18), (1, "B", 8, 12)]
    assert "Aggregate" not in plan(out)


def test_overlap_reads_each_side_once(spark):
    side = lambda rows: spark.createDataFrame(rows, "doc long, start long, end long, type string, text string")
    gold = side([(1, 0, 5, "A", "x"), (1, 0, 5, "A", "x"), (1, 8, 9, "A", ""), (1, 8, 9, "A", None), (None, 0, 5, "A", "x"), (2, 0, 4, "B", "y"), (2, None, 4, "B", "y")])
    pred = side([(1, 4, 7, "A", "z"), (1, 8, 10, "A", None), (None, 0, 5, "A", "x"), (2, 0, 4, "A", "y"), (2, 3, 9, "B", "")])
    out = M.overlap(gold, pred)
    assert {r.type: (r.tp, r.fp, r.fn) for r in out.collect()} == {"A": (1, 2, 1), "B": (0, 1, 1), "overall": (1, 3, 2)}
    assert "Join" not in plan(out) and plan(out).count("LogicalRDD") == 2


def test_selected_fields_meet_in_their_record(spark):
    records = spark.createDataFrame([(1, 5, "A", "k1"), (1, 2, "A", "k1"), (1, 3, "B", "k2"), (1, None, "A", "k3"), (2, 1, None, "k1"), (2, 1, "A", " "), (None, 1, "A", "k1")], "id long, ord long, title string, key string")
    rows = lambda out: sorted(((r.id, r.title, r.key) for r in out.collect()), key=str)
    assert rows(V.selected_fields(records, "all", cap=2)) == [(1, "A", "k1"), (1, "A", "k3"), (2, None, "k1"), (None, "A", "k1")]
    out = V.selected_fields(records, "added", records.select("id", "key", "ord"), exclude=["k3"])
    assert rows(out) == [(1, "A", "k1"), (1, "A", "k2"), (1, "B", "k1"), (1, "B", "k2"), (2, "A", "k1"), (2, None, "k1")]
    assert "Join" not in plan(out)
