"""Versioned outputs, readers with an error channel, and appends that survive a restart."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.sources import io, sinks
from spanlake.streaming import lines


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"))
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    first = sinks.write_version(rows, path, ["train", "val", "test"])
    assert first["outputs"] == {"train": 75, "val": 25, "test": 0} and first["rows"] == 100

    @F.udf("long")
    def killed(i):
        if i == 99:
            raise RuntimeError("lost half-way")
        return i

    with pytest.raises(Exception, match="lost half-way"):
        sinks.write_version(rows.repartition(4).withColumn("id", killed("id")), path, ["train", "val", "test"])
    assert sinks.current(spark, path) == first
    assert {r.id for r in sinks.read_version(spark, path, "val").collect()} == set(range(0, 100, 4))
    assert sinks.read_version(spark, path, "test").collect() == []
    with pytest.raises(ValueError):
        sinks.read_version(spark, path, "other")


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    first = sinks.write_version(spark.range(5).withColumn("x", F.lit("ä")), path)

    def broken(*_):
        raise OSError("disk is gone")

    monkeypatch.setattr(sinks._Files, "write", broken)
    with pytest.raises(OSError):
        sinks.write_version(spark.range(9), path)
    monkeypatch.undo()
    assert sinks.current(spark, path) == first and sinks.read_version(spark, path).count() == 5
    second = sinks.write_version(spark.range(7), path, format="parquet", keep=1)
    assert sinks.read_version(spark, path).count() == 7 and second["versions"] == [second["version"]]
    left = {p.name for p in (tmp_path / "out").iterdir()} - {"_manifest.json", "._manifest.json.crc"}
    assert left == {second["version"]}


def test_only_selected_outputs_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, None), (4, "eval")], "id long, split string")
    made = sinks.write_version(rows, path, ["val", "eval"])
    assert made["outputs"] == {"val": 1, "eval": 1} and {r.id for r in sinks.read_version(spark, path).collect()} == {2, 4}


def test_exports_with_an_error_channel(spark, tmp_path):
    task = lambda i: {"id": str(i), "data": {"text": "t"}, "annotations": [{"id": "a", "was_cancelled": False, "result": []}]}
    files = {"a.json": json.dumps([task(1), task(2)]), "b.json": json.dumps([task(3), 5, "x", {"id": "4", "annotations": "wrong"}]), "c.json": "[{\"id\": \"9\"}, {", "d.json": json.dumps(task(8)), "e.json": "", "f.json": "[]", "g.json": "﻿" + json.dumps([task(7)], indent=2)}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    tasks, problems = io.read_exports(spark, [str(tmp_path / n) for n in [*files, "none.json", "none.json"]])
    assert sorted(r.id for r in tasks.collect()) == ["1", "2", "3", "7"]
    assert {(r.path.rsplit("/", 1)[1], r.reason, r.n) for r in problems.collect()} == {("none.json", "missing", 1), ("b.json", "not a task", 3), ("c.json", "not an array", 1), ("d.json", "not an array", 1), ("e.json", "not an array", 1)}
    tasks, problems = io.read_exports(spark, [str(tmp_path / "none.json")])
    assert tasks.collect() == [] and problems.count() == 1
    assert io.annotation_rows(io.read_exports(spark, [str(tmp_path / "a.json")])[0]).count() == 2


def test_key_dictionaries_with_counts(spark, tmp_path):
    line = lambda title, key, raw: json.dumps({"报告名": title, "键名": {"标准名": key, "别名": raw}}, ensure_ascii=False)
    rows = [
        line("手术", "切口", [["切口描述", ""], ["切口情况", "备注"]]), line("手术", "日期", "手术日期"), "{broken", "", line("病理", "诊断", {"aliases": ["结论", "诊断", "结论"]}),
        line("手术", "切口", ["伤口", "切口描述"]), json.dumps({"report_name": " 手术 ", "键名": {"canonical": "术者"}}, ensure_ascii=False), line("", "x", None), line("手术", "", []), "[1, 2]", json.dumps({"报告名": "手术", "键名": "无"}, ensure_ascii=False),
    ]
    (tmp_path / "keys.jsonl").write_text("\n".join(rows) + "\n")
    structure, aliases, counts = io.read_key_dictionary(spark, str(tmp_path))
    assert {(r.title, r.ord): r.key for r in structure.collect()} == {("手术", 0): "切口", ("手术", 1): "日期", ("手术", 2): "术者", ("病理", 0): "诊断"}
    assert {(r.title, r.key, r.ord): r.alias for r in aliases.collect()} == {("手术", "切口", 0): "切口描述", ("手术", "切口", 1): "切口情况", ("手术", "切口", 2): "伤口", ("手术", "日期", 0): "手术日期", ("病理", "诊断", 0): "结论"}
    assert [tuple(r)[1:] for r in counts.collect()] == [(5, 3, 2)]


def test_text_folders_and_ocr_pages(spark, tmp_path):
    for name, text in {"U1/a.txt": "one", "U1/deep/b.txt": "two\nlines", "U2/_all.txt": "all", "U2/c.txt": " ", "other/d.txt": "no", "U3/e.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.text for r in io.text_files(spark, str(tmp_path)).collect()} == {"one", "two\nlines"}
    page = {"page": "p", "words_result": [{"words": w, "location": {"left": i, "top": 0, "width": 10, "height": 2}} for i, w in enumerate("abc")], "paragraphs_result": [{"words_result_idx": [0, 1]}, {"words_result_idx": [2, 9]}]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    pages = spark.read.schema(io.OCR_SCHEMA).json(str(tmp_path / "page.json"))
    assert [(r.line, r.words, r.left, r.right) for r in io.ocr_lines(pages).collect()] == [(0, "a", 0, 10), (1, "b", 1, 11), (2, "c", 2, 12)]
    assert io.ocr_paragraphs(pages).first().text == "ab\n\nc"


def test_restart_makes_no_double_rows(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)

    @F.udf("long")
    def killed(i):
        if i >= 10 and not __import__("os").path.exists(f"{tmp_path}/mended"):
            raise RuntimeError("the batch is lost")
        return i

    first = lines.append_once(stream.select(killed("id").alias("id")), out, state, once=True)
    with pytest.raises(Exception, match="the batch is lost"):
        first.awaitTermination(120)
    (tmp_path / "mended").write_text("")
    # What a lost driver may leave of the batch that was under way:
    spark.range(10, 13).write.json(f"{out}/batch=1") if not (tmp_path / "out/batch=1").exists() else None
    for _ in range(2):
        lines.append_once(stream.select(killed("id").alias("id")), out, state, once=True).awaitTermination(120)
    rows = lines.read_appended(spark, out, "id long").collect()
    assert sorted(r.id for r in rows) == list(range(30)) and {r.batch for r in rows} == {0, 1, 2}
