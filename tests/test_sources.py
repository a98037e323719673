"""Readers, masking, chunking invariants and streams."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.functions import mask as K
from spanlake.functions import text as T
from spanlake.operators import assemble as A
from spanlake.operators import chunk as C
from spanlake.operators import curate as Q
from spanlake.operators import spans as S
from spanlake.sources import io
from spanlake.streaming import lines


def test_records(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert [r.a for r in io.read_records(spark, str(p), "a int", lenient=True).collect()] == [1, 2]
    with pytest.raises(Exception):
        io.read_records(spark, str(p), "a int").collect()


def test_export(spark, tmp_path):
    result = [{"id": "k", "type": "labels", "value": {"start": 0, "end": 2, "text": "ab", "labels": ["name"]}}, {"id": "v", "type": "labels", "value": {"start": 3, "end": 5, "text": "cd", "labels": ["val"]}}]
    result += [{"id": "z", "type": "labels", "value": {"start": 5, "end": 5, "text": "", "labels": ["val"]}}, {"type": "relation", "from_id": "k", "to_id": "v", "direction": "right"}]
    notes = [{"id": "1", "was_cancelled": True, "updated_at": "9", "result": []}, {"id": "2", "was_cancelled": False, "updated_at": "1", "result": result}]
    p = tmp_path / "e.json"
    p.write_text(json.dumps([{"id": "t", "data": {"text": "ab cd"}, "annotations": notes}]))
    ann = A.latest(io.annotation_rows(io.read_records(spark, str(p), io.TASK_SCHEMA, multiline=True)))
    spans, rel = io.entities_and_relations(ann, {"name": "KEY", "val": "VALUE"})
    assert spans.count() == 2
    out = A.by_relation(spans, rel).collect()
    assert [(r.key, r.value, r.start, r.end) for r in out] == [("ab", "cd", 3, 5)]


def test_dictionary_and_fields(spark):
    nodes = spark.createDataFrame([("t", '["a", "b"]'), ("u", '{"c": {"别名": ["x", "c", ""]}, "d": "y"}')], "title string, value string")
    got = {(r.title, r.key, r.alias) for r in io.dictionary_rows(nodes).collect()}
    assert got >= {("t", "a", None), ("u", "c", "x"), ("u", "d", "y")}
    lines_ = spark.createDataFrame([(1, '{"report_title": "T", "f": "1", "g": " ", "report": "x"}'), (2, "bad")], "id long, value string")
    assert [(r.id, r.title, r.key, r.value) for r in io.field_rows(lines_).collect()] == [(1, "T", "f", "1")]


def test_masking(spark):
    cases = {
        "编号 110101199003071234 完": "编号 110101********1234 完",
        "电话13812345678。": "电话138123****8。",
        "病案号：AB12345 单位：某某工厂": "病案号: AB***45 单位: 某某**",
        "姓名：张三丰，好": "姓名：张**，好",
        "地址：某地\n下": "地址：*\n下",
        "姓 名：王小明 签  名 李四": "姓 名：王** 签  名 李*",
        "医师：王小明": "医师：王小明",
        "单位：某某工厂\x00，尾": "单位: 某某***，尾",
        "\x00病案号：AB12345 尾\x00尾": "\x00病案号: AB***45 尾\x00尾",
        "nothing": "nothing",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,), ("",)], "t string").select("t", K.mask_all(F.col("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == cases | {None: None, "": ""}


def test_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.shorten_value(F.lit("联系电话"), F.lit("x 13912345678 y"), F.lit(10))).asDict() == {"text": "13912345678", "start": 12, "end": 23}
    assert one(T.strip_punctuation(F.lit("。，"), F.lit(3), F.lit(5))).asDict() == {"text": "。，", "start": 5, "end": 5}
    assert one(T.normal_value(F.lit("（ＡＢ，c）"))) == "AB,c"
    assert one(T.token_count(F.lit("胃ab1, 😀"))) == 4


def test_windows_cover_the_text(spark):
    text = "".join(f"w{i} " for i in range(100))
    out = C.token_windows(spark.createDataFrame([(1, text), (2, "x y"), (3, "")], "doc_id long, text string"), 30, 10).orderBy("doc_id", "chunk").collect()
    one = [r for r in out if r.doc_id == 1]
    assert [r.first_token for r in one] == [0, 20, 40, 60, 80] and one[-1].end_token == 100
    assert [r.chunk_text for r in out if r.doc_id != 1] == ["x y", ""]
    with pytest.raises(ValueError):
        C.token_windows(spark.createDataFrame([(1, "")], "doc_id long, text string"), 5, 5)


def test_splits_are_exact_for_any_partitioning(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    a, b = (Q.ratio_split(rows.repartition(n), "doc_id", [("train", 0.7), ("val", 0.2), ("test", 0.1)], 1) for n in (1, 7))
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 700, "val": 200, "test": 100}
    assert a.exceptAll(b).isEmpty()


def test_shards_keep_the_budget(spark):
    rows = spark.range(3000).withColumn("x", F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")))
    size = F.octet_length(F.to_json(F.struct("id", "x")))
    out = Q.shards(rows, "id", 5000).groupBy("shard").agg(F.sum(size).alias("n"), F.max(size).alias("m")).collect()
    assert all(r.n <= 5000 for r in out) and sum(r.n for r in out) == rows.agg(F.sum(size)).first()[0]


def test_shards_are_greedy_over_ranges_of_bytes(spark):
    """Ids far apart, a row above the budget, and ties: shards follow the bytes, not the ids."""
    import json

    rnd = __import__("random").Random(3)
    rows = [(i * 5000, "x" * rnd.choice([1, 5, 20, 70])) for i in range(300)]
    size = lambda r: len(json.dumps({"id": r[0], "v": r[1]}, separators=(",", ":")))
    want, total, n, last = {}, 0, 0, None
    for r in rows:
        part = total // (60 * 4)
        if part != last:
            last, shard, n = part, 0, 0
        elif n and n + size(r) > 60:
            shard, n = shard + 1, 0
        n, total = n + size(r), total + size(r)
        want[r[0]] = f"{part}-{shard}"
    frame = spark.createDataFrame(rows, "id long, v string").repartition(5)
    assert {r.id: r.shard for r in Q.shards(frame, "id", 60, spread=4).collect()} == want
    assert len(set(want.values())) < len(rows)
    assert Q.shards(frame.limit(0), "id", 60).collect() == []



def test_separators_and_scorer_context(spark):
    rows = spark.createDataFrame([("a", i, i in (1, 4)) for i in range(6)], "id string, ord int, blank boolean")
    got = [r.separator for r in Q.balanced_separators(rows, "id", "ord", F.col("blank")).orderBy("ord").collect()]
    assert got == ["：", " ", ":", "：", " ", ":"]
    records = spark.createDataFrame([(1, 2, "t", "b"), (1, 1, "t", "a"), (2, 1, "u", "a")], "id int, ord int, title string, key string")
    aliases = spark.createDataFrame([("t", "a", "a2", 2), ("t", "a", "a1", 1)], "title string, key string, alias string, ord int")
    assert {r.id: r.query for r in Q.scorer_queries(records, aliases).collect()} == {1: "t a a1 a2 b", 2: "u a"}
    assert spark.range(1).select(Q.shown_examples(F.array(F.lit("abcd"), F.lit("abc")), 3).alias("x")).first().x == ["abc…", "abc"]


def test_items_are_found_anywhere(spark):
    docs = spark.createDataFrame([(1, "one alpha\nbeta two"), (2, "x one  alphabet y"), (3, ""), (4, None), (5, "a b c d"), (6, "za b cz")], "doc int, body string")
    items = spark.createDataFrame([(1, "one alpha"), (2, "alpha"), (3, "a b c"), (4, ""), (5, None), (6, "one  alpha"), (7, "no such thing here")], "item int, value string")
    got = {(r.item, r.doc, r.start, r.end) for r in S.found_anywhere(docs, items).collect()}
    want = {(i, d, b.find(v), b.find(v) + len(v)) for d, b in ((r.doc, r.body) for r in docs.collect()) for i, v in ((r.item, r.value) for r in items.collect()) if b and v and v in b}
    assert got == want and len(want) == 6


def test_stream(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    spark.range(200).selectExpr("cast(id as string) as id", "id * 2 as v").write.json(src)
    (tmp_path / "in" / "bad.json").write_text("{nope\n")
    stream = lines.read_lines(spark, src, "id string, v long", lines.in_training(F.col("id"), 0.5))
    lines.append(stream, out, ckpt, once=True).awaitTermination()
    got = {r.id for r in spark.read.schema("id string, v long").json(out).collect()}
    batch = {r.id for r in spark.range(200).select(F.col("id").cast("string").alias("id")).filter(lines.in_training(F.col("id"), 0.5)).collect()}
    assert got == batch and 60 < len(got) < 140


def test_review_tasks(spark):
    r = io.review_tasks(spark.createDataFrame([(1, "a<b", "x&y", 0)], "id long, key string, value string, ord int")).first()
    assert r.table == "<table><tr><td>a&lt;b</td><td>x&amp;y</td></tr></table>" and json.loads(r.body) == [{"key": "a<b", "value": "x&y"}]


def test_shards_of_a_range_of_very_many_rows(spark):
    import time

    began = time.time()
    n = spark.range(200_000)
    assert Q.shards(n, "id", 100_000).select("shard").distinct().count() == -(-n.select(F.sum(F.octet_length(F.to_json(F.struct("id"))))).first()[0] // 100_000)
    assert time.time() - began < 40
