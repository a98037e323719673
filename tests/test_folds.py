"""Folds on small literals: texts are kept whole, budgets hold."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__
from spanlake.functions import text as T
from spanlake.operators import compose as P
from spanlake.operators import fold as D
from spanlake.operators import prefix


def test_sentence_chunks(spark):
    text = "".join(f"{'x' * n}." for n in (40, 30, 50, 5, 90, 3))
    out = D.sentence_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), ".", 80, 30, 4).orderBy("doc_id", "chunk").collect()
    assert [len(r.body) for r in out] == [72, 57, 95]
    assert "".join(r.body for r in out) == text


def test_breaks_after_values(spark):
    docs = spark.createDataFrame([(1, "aa bb KEY1 cc dd KEY2 ee ff KEY1 gg", ["KEY1", "KEY2", "x"]), (2, "short KEY1", ["KEY1"]), (3, "aa bb cc dd ee ff gg hh", [])], "doc_id long, text string, values array<string>")
    got = {r.doc_id: r.text for r in D.breaks_after_values(docs, 6).collect()}
    assert got == {1: "aa bb KEY1 cc dd KEY2\n\n ee ff KEY1 gg", 2: "short KEY1", 3: "aa bb cc dd ee ff gg hh"}


def test_pack_and_items(spark):
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(["a b", "c", "d e f g", "h"])], "id long, ord int, line string")
    out = D.packed_items(rows, 3, ["；", " | "]).orderBy("par").collect()
    assert [r.body for r in out] == ["a b；c", "d e f g", "h"]


def test_json_object(spark):
    cases = [('x {"a": 1} y', '{"a": 1}'), ('```json\n{"b": {"c": 2}}\n```', '{"b": {"c": 2}}'), ("none", None), ("{bad", None)]
    cases += [('{"a":1} x {"b":2}', '{"a":1}'), (' {"a": "}"} ', '{"a": "}"}'), ('x {"a": "}"} y', None), ("}{}", "{}"), ("", None), (None, None), ('[1] {"a": [{}]}', '{"a": [{}]}'), ('t\n```\n{"q": "\\\\"}\n``` {', '{"q": "\\\\"}')]
    got = spark.createDataFrame(cases, "t string, want string").select("want", D.json_object(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def brute_cuts(text, keys, budget):
    count = lambda t: len(re.findall(TOKENS, t))
    if count(text) <= budget:
        return [text]
    places, out, last = sorted({m.start() for k in keys for m in re.finditer(f"(?={re.escape(k)})", text)}), [], 0
    for p in places:
        if p > last and count(text[last:p]) > budget:
            out.append(text[last:p])
            last = p
    return [*out, text[last:]]


TOKENS = r"[一-鿿]|[A-Za-z0-9]+|[^\sA-Za-z0-9一-鿿]"


def test_cuts_before_keys(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(["ab ", "cd", " key1", "键", "7 ", "kk ", "\n"]) for _ in range(rnd.randint(1, 60))), ["key1", "键", "kk", "d k"][: i % 5]) for i in range(60)]
    rows += [(60, "", ["a"]), (61, None, ["a"]), (62, "a b c d e f g h", [])]
    out = D.cut_at_keys(spark.createDataFrame(rows, "doc_id int, text string, keys array<string>"), 6, "@@").orderBy("doc_id", "chunk").collect()  # no blank lines
    got = {i: [] for i, *_ in rows}
    for r in out:
        assert rows[r.doc_id][1][r.start : r.end] == r.body
        got[r.doc_id].append(r.body)
    count = {r.doc_id: r.n for r in spark.createDataFrame(rows, "doc_id int, text string, keys array<string>").select("doc_id", T.token_count(F.col("text")).alias("n")).collect()}
    assert all(count[i] == len(re.findall(TOKENS, t)) for i, t, _ in rows if t)
    assert got == {i: (brute_cuts(t, k, 6) if t else []) for i, t, k in rows}


def test_cut_at_keywords_and_breaks(spark):
    df = spark.createDataFrame([(1, "value one\nKey: rest", "ab The cd The ef")], "doc_id long, t string, text string")
    assert df.select(D.cut_at_keywords(F.col("t"), ["Key"]).alias("x")).first().x == "value one"
    assert D.breaks_before(df, ["The "], 4).first().text == "ab The cd \nThe ef"


def test_near_duplicates_have_members_and_null_blocks(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(1, a, "en"), (2, a, "en"), (3, b, "en"), (4, a, None), (5, b, None), (6, b, None), (7, "", None), (8, None, "en"), (9, a, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (1, 1000):  # 1: every shared shingle is dealt into sub-blocks
        assert {tuple(r) for r in P.near_duplicate_pairs(docs, "lang", meeting_rows=size).collect()} == {(1, 3), (4, 5)}
    assert sorted(tuple(r) for r in P.near_duplicate_members(docs, "lang").collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9)]


def test_breaks_after_words_of_the_whole_text(spark):
    """Against brute force; and the registered query's values aren't a text's first words only."""

    def brute(text, budget):
        values = {v for v in text.split(" ") if len(v) >= 3}
        tokens = lambda t: len(re.findall(r"[\u4e00-\u9fff]|[A-Za-z0-9]+|[^\w \t\n\r\x0b\x0c\xa0\u3000]", t))
        if tokens(text) <= budget:
            return text
        cuts = [p for p in range(1, len(text) + 1) if any(text[:p].endswith(v) for v in values)]
        pieces, out, n = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])], [], 0
        for x in pieces:
            k = tokens(x)
            if out and n + k <= budget:
                out[-1], n = out[-1] + x, n + k
            else:
                out, n = [*out, x], k
        return "\n\n".join(out)

    rnd = random.Random(3)
    parts = ["ab", "abc", "abcab", "cabc", "\U0001f600\U0001f600", "\U0001f600abc", "x\\Ey", "a\nb", "a.c", "", "é", "long" * 3]
    texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 60))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (80, ""), (81, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.breaks_after_words(docs, 7).collect()}
    assert got == {i: brute(t, 7) for i, t in enumerate([*texts, ""])} | {81: None}


def test_e8_takes_values_from_the_whole_text(spark, tmp_path):
    words = " ".join(f"w{i:03}" for i in range(400))
    spark.createDataFrame([(1, words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = __spark_entry__.queries()["e8_breaks_after_values"](spark, str(tmp_path)).first()
    assert r.n == len(words) + 2 * 3  # breaks after 100, 200 and 300 words


def test_places_of_many_keys_take_one_pass():
    import time

    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("abc\U0001f600") for _ in range(rnd.randrange(0, 30)))
        keys = ["".join(rnd.choice("abc\U0001f600") for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(0, 4))]
        assert D.places(text, keys) == [i for i in range(len(text)) if any(text.startswith(k, i) for k in keys)]
    words = [f"{rnd.randrange(10**12):012}" for _ in range(20_000)]
    began = time.time()
    assert len(D.places(" ".join(words), words)) >= 20_000
    assert time.time() - began < 20


def test_long_texts_of_many_words_fold_in_time(spark):
    import time

    rnd = random.Random(5)
    words = [f"word{rnd.randrange(10**9):09}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    began = time.time()
    assert D.breaks_after_words(docs, 100).first().text.count("\n\n") == 199
    chunks = D.cut_at_keys(docs.select("*", F.array_distinct(F.split("text", " ")).alias("keys")), 60).collect()
    assert len(chunks) == 328 and "".join(c.body for c in sorted(chunks, key=lambda c: c.chunk)) == " ".join(words)
    assert time.time() - began < 60



def test_near_duplicates_meet_by_rare_shingles_and_compare_in_groups(spark, monkeypatch):
    """Against brute force, with homes of a few sets; and only prefixes become rows: every shingle did before."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        w = [rnd.choice(vocabulary) for _ in range(80)]
        for k in range(12):
            x = list(w)
            for _ in range(rnd.randrange(5)):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            rows.append((100 * base + k, "  ".join(x), "en" if base else None))
    rows += [(900, "a b", "en"), (901, "a\tb\n", "en"), (902, "A b", "en"), (903, None, "en"), (904, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    sets = {}
    for i, t, lang in rows:
        w = (t or "").split()
        if w:
            sets.setdefault((lang, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))), i)
    want = {(min(i, j), max(i, j)) for (a, x), i in sets.items() for (b, y), j in sets.items() if i < j and a == b and 4 * len(x & y) >= 3 * len(x | y)}
    assert len(want) > 40
    got = [tuple(r) for r in P.near_duplicate_pairs(docs, "lang").collect()]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(prefix, "HOME_ROWS", 2)
    assert {tuple(r) for r in P.near_duplicate_pairs(docs, "lang", meeting_rows=3).collect()} == want
    sets = P._shingle_sets(docs, "lang", 5).filter("g is not null")
    found = prefix.prefixes(sets, prefix.frequency_order(sets), 0.75)
    assert found.filter("size(prefix) <> n - ceil(0.75 * n) + 1").count() == 0
    some = docs.filter("doc_id in (3, 903)").select("doc_id")
    assert {3, 903} <= {r.doc_id for r in prefix.passing(docs, some).collect()}
