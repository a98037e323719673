"""NFKC, ladder chunks, alias filling and similarity with a lexicon against plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.functions import unicode as U
from spanlake.operators import aliasfill as A
from spanlake.operators import ladder as L


def test_nfkc_in_full(spark):
    texts = ["ﬁ ﬀ ﬃ", "①⑳㎎㎏½¼", "ｶﾞ ＡＢＣ：", "é å", "Ⅳ ™ …", "", None, "名　称：", "한가", "x﻿ y" * 50]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", U.nfkc("t").alias("n"), U.full_key(F.col("t")).alias("k"), U.full_value(F.col("t")).alias("v")).collect()
    for r in out:
        assert r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t))
    assert out[1].k == "120mgkg1⁄21⁄4" and out[2].k == "ガABC" and out[7].v == "名 称"


def slow_ladder(text, most, ladder, tiny):
    """Character by character."""
    clean = L.cleaned
    parts, current, count, i = [], [], 0, 0

    def flush(raw):
        raw = raw.strip()
        if raw and parts and len(clean(raw)) <= tiny:
            parts[-1] = (parts[-1][0] + raw, parts[-1][1] + clean(raw))
        elif raw:
            parts.append((raw, clean(raw)))

    while i < len(text):
        current.append(text[i])
        count += text[i] not in "\n\t \\ntr"
        i += 1
        if count >= most:
            chunk, cut = "".join(current), None
            for least in ladder:
                for j in range(len(chunk) - 1, -1, -1):
                    if chunk[j] == "。" and len(clean(chunk[: j + 1])) >= least:
                        cut = j + 1
                        break
                if cut:
                    break
            if cut is None:
                while i < len(text):
                    current.append(text[i])
                    i += 1
                    if current[-1] in ")）]】 \n\t":
                        break
                cut = len(current)
            flush("".join(current[:cut]))
            current = current[cut:]
            count = len(clean("".join(current)))
    flush("".join(current))
    return parts


@pytest.mark.parametrize("most, ladder, tiny", [(20, (15, 9, 4), 3), (500, (448, 256, 128), 10), (7, (6,), 0)])
def test_ladder_chunks_equal_plain_python(spark, most, ladder, tiny):
    rnd = random.Random(4)
    alphabet = [*"甲乙丙丁abnrt\\", "。", " ", "\n", "）", "\\n"]
    texts = ["".join(rnd.choices(alphabet, [6] * 10 + [rnd.choice([0, 1, 4])] + [1, 1, rnd.choice([0, 1]), 1], k=rnd.randrange(1, 3 * most))) for _ in range(120)]
    texts += ["甲" * (most * 3), "甲" * most + "。", " \n ", "。" * most * 2]  # no marks, one mark, nothing, marks only
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x")]
    out = L.ladder_chunks(spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(3), most, ladder, tiny).collect()
    got = {i: [] for i in range(len(texts))}
    for r in sorted(out, key=lambda r: (r.doc_id, r.chunk)):
        got[r.doc_id].append((r.raw, r.body))
    assert got == {i: slow_ladder(t, most, ladder, tiny) for i, t in enumerate(texts)}


def test_alias_keys_are_remapped_and_logged(spark):
    structure = spark.createDataFrame([("t", " 诊断 "), ("t", "日期"), ("u", "术者")], "title string, key string")
    decisions = spark.createDataFrame([("t", "结论", "诊断", 0.9, "same"), ("t", "day", "日期", 0.8, "date"), ("t", "lost", "术者", 0.7, "other title")], "title string, data_key string, mapped string, confidence double, reason string")
    rows = [(1, "t", "诊断", "dx", 0), (1, "t", "x1", "结论", 1), (1, "t", "day", " ", 2), (1, "t", "y", "lost", 3), (1, "t", "z", None, 4), (2, "u", "术者", "surgeon", 0), (3, "t", "x9", "结论", 1), (3, "t", "诊断", "dx", 2)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "id long, title string, key string, alias string, ord int, name string")
    out = {(r.id, r.key): (r.task, r.canon, r.confidence, r.reason, r.taken) for r in A.remapped_aliases(frame, structure, decisions).collect()}
    assert out == {
        (1, "诊断"): ("kept", " 诊断 ", None, None, True), (1, "x1"): ("alias_key_remap", " 诊断 ", 0.9, "same", False), (1, "day"): ("alias_key_remap", "日期", 0.8, "date", True),
        (1, "y"): ("alias_key_remap_failed", None, None, None, False), (1, "z"): ("alias_key_remap_failed", None, None, None, False), (2, "术者"): ("kept", "术者", None, None, True),
        (3, "x9"): ("alias_key_remap", " 诊断 ", 0.9, "same", True), (3, "诊断"): ("kept", " 诊断 ", None, None, False),
    }


def test_missing_aliases_are_filled(spark):
    structure = spark.createDataFrame([("t", k) for k in ("a", "b", "c", "d", "e", "f")], "title string, key string")
    records = spark.createDataFrame([(1, "t", "a", "v1"), (1, "t", "b", "v2"), (1, "t", "c", " "), (1, "t", "extra", "v5"), (1, "t", "f", "v6")], "id long, title string, key string, value string")
    aliases = spark.createDataFrame([(1, "t", "a", "old"), (1, "t", "b", "N/A"), (1, "t", "d", "unused")], "id long, title string, key string, alias string")
    reports = spark.createDataFrame([(1, "head v2 tail")], "id long, report string")
    mappings = spark.createDataFrame([("t", "extra", "e")], "title string, data_key string, mapped string")
    found = spark.createDataFrame([("b", "v2", "标签: 甲为v"), ("e", "v5", "乙")], "key string, value string, alias string")
    out = {r.key: (r.alias, r.task, r.value, r.found) for r in A.filled_aliases(aliases, structure, records, reports, mappings, found).collect()}
    assert out == {"a": ("old", None, "v1", False), "b": ("甲", "fill_missing", "v2", True), "c": ("", "fill_missing", None, False), "d": ("", "fill_missing", None, False), "e": ("乙", "fill_from_mapping", "v5", True), "f": ("", "fill_missing", "v6", False)}


def test_similarity_looks_into_its_lexicon_first(spark):
    lexicon = spark.createDataFrame([("ab", "cd", 0.9), ("xy", "yx", 0.2), ("yx", "xy", 0.3), ("", "q", 0.7), ("ab", "cd", 0.5), (None, "q", 1.0)], "a string, b string, score double")
    pairs = [("ab", "cd", 0.9), ("cd", "ab", 0.9), ("xy", "yx", 0.2), ("yx", "xy", 0.3), ("", "q", 0.0), (None, "q", 0.0), ("abc", "abd", 0.5), ("q", "q", 1.0)]
    rows = A.lexicon_similarity(spark.createDataFrame(pairs, "a string, b string, want double"), lexicon).collect()
    assert len(rows) == len(pairs) and all(r.score == r.want for r in rows), rows


def test_python_functions_on_texts_have_bounded_batches(spark):
    from spanlake.functions import batches
    from spanlake.functions import mask as K
    from spanlake.operators import ladder

    docs = spark.createDataFrame([(1, "a。b")], "doc_id long, text string")
    for make in (lambda: ladder.ladder_chunks(docs), lambda: docs.select(K.mask_all(docs.text))):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        make()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(batches.BYTES)
