"""Question samples, dynamic spans and layout breaks against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.operators import layout as L
from spanlake.operators import samples as Q
from spanlake.operators import spans as S

TOKEN = re.compile(r"[一-鿿]|[A-Za-z0-9]+|[^\w\s]")


def brute_samples(text, start, end, budget):
    """(char_start, char_end, answer_start, answer_end) of one question, without sampling of negatives."""
    pars, at = [], 0
    for p in text.split("\n\n"):
        pars.append((at, at + len(p)))
        at += len(p) + 2
    if len(pars) > 1 and pars[-1][0] == pars[-1][1]:
        pars.pop()
    n, found = len(pars), 0 <= start < end
    if found:
        first = next((i for i, (a, b) in enumerate(pars) if a <= start < b), 0)
        last = next((i for i, (a, b) in enumerate(pars) if a < end <= b), n - 1)
        parts = [(first, min(last + 1, n - 1))]
    elif n > 3:
        size = min(5, max(3, n // 4))
        parts, i = [], 0
        while True:
            parts.append((i, min(i + size, n) - 1))
            if i + size >= n:
                break
            i += max(1, size // 2)
    else:
        parts = [(0, n - 1)]
    chunks = []
    for a, b in parts:
        if sum(len(TOKEN.findall(text[s:e])) for s, e in pars[a : b + 1]) > budget and b > a:
            chunks += [(s, e) for s, e in pars[a : b + 1] if e > s]
        else:
            chunks.append((0, len(text)) if not found and n <= 3 else (pars[a][0], pars[b][1]))
    s, e = start, end
    while found and s < e and text[s].isspace():
        s += 1
    while found and e > s and text[e - 1].isspace():
        e -= 1
    while found and e > s and text[e - 1] in Q.ANSWER_TAIL:
        e -= 1
    out = []
    for i, (a, b) in enumerate(chunks):
        if found and (s < a or e > b):
            continue
        out.append((i, "positive" if found and e > s else "negative", a, b, *((s - a, e - a) if found and e > s else (-1, -1))))
    return out


def test_question_samples_equal_plain_python(spark):
    rnd, docs, asked, want = random.Random(2), [], [], set()
    for doc in range(40):
        pars = [" ".join(rnd.choice(["ab", "c1", "名", "，", "x；"]) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(1, 14))]
        text = "\n\n".join(pars) + rnd.choice(["", "\n\n"])
        docs.append((doc, text))
        for key in ("k1", "k2", "k3"):
            start = rnd.choice([-1, rnd.randrange(len(text) + 1)])
            end = min(len(text), start + rnd.randrange(12)) if start >= 0 else -1
            asked.append((doc, key, "why ？", start, end, True))
            if text:
                want |= {(doc, key, *r) for r in brute_samples(text, start, end, max(1, min(20, 26 - 2 - 3)))}
    frame = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, key string")
    questions = spark.createDataFrame([(*r, 0) for r in asked], "doc_id long, key string, question string, start int, end int, present boolean, chunk int")
    out = {tuple(r) for r in Q.question_samples(frame, questions, 20, 26, None).collect()}
    assert out == want and {r[3] for r in want} == {"positive", "negative"}


def test_negatives_are_kept_by_share(spark):
    docs = spark.createDataFrame([(i, "one\n\ntwo") for i in range(400)], "doc_id long, text string")
    asked = docs.select("doc_id", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("key"), F.lit("q").alias("question"), F.lit(-1).alias("start"), F.lit(-1).alias("end")).withColumn("present", F.col("key") == "in")
    kept = {r.key: r.n for r in Q.question_samples(docs, asked, 20, 30, 0.5).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert 150 < kept["in"] < 250 and 20 < kept["out"] < 65


def test_questions_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (3, "x")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "k", None, 0, 1, None), (2, "k", "q", None, None, True), (None, "k", "q", -1, -1, True), (3, "k", None, None, None, None), (9, "k", "q", -1, -1, True)], "doc_id long, key string, question string, start int, end int, present boolean")
    assert [tuple(r) for r in Q.question_samples(docs, asked, 5, 9, None).collect()] == [(3, "k", 0, "negative", 0, 1, -1, -1)]
    assert Q.question_samples(docs.limit(0), asked, 5, 9).collect() == []


def brute_span(tokens, top, alpha, longest, short_cap, boost, short):
    tail = lambda s: [e for i, _, e in tokens if i >= s]

    def reach(s):
        x = [math.exp(e - max(tail(s))) for e in tail(s)]
        run, n = 0.0, 0
        for v in x:
            run, n = run + v, n + 1
            if run / sum(x) >= alpha:
                break
        return max(1, min(n, longest, short_cap if short else longest))

    score = lambda s, e, a, b: a + b + (boost * (8 - (e - s + 1)) / 8 if short and e - s + 1 <= 8 else 0)
    starts = sorted(tokens, key=lambda t: (-t[1], t[0]))[:top]
    ends = sorted(tokens, key=lambda t: (-t[2], t[0]))[:top]
    found = [(-score(s, e, a, b), s, e) for s, a, _ in starts for e, _, b in ends if s <= e < s + reach(s)]
    if not found:
        s, a, _ = starts[0]
        e, _, b = min((t for t in tokens if s <= t[0] < s + reach(s)), key=lambda t: (-t[2], t[0]))
        found = [(-score(s, e, a, b), s, e)]
    best = min(found)
    return best[1], best[2], round(-best[0], 9)


@pytest.mark.parametrize("top, longest", [(1, 3), (3, 2), (20, 128)])
def test_dynamic_spans_equal_plain_python(spark, top, longest):
    rnd, rows, want = random.Random(7), [], {}
    for doc in range(50):
        tokens = [(i + 3, rnd.randrange(-8, 9) / 2, rnd.choice([rnd.randrange(-6, 7) / 2, -900.0, 40.0])) for i in range(rnd.randrange(1, 30))]
        short = doc % 2 == 0
        rows += [(doc, 0, i, s, e, short, "x") for i, s, e in tokens]
        want[doc] = brute_span(tokens, top, 0.9, longest, 4, 0.3, short)
    logits = spark.createDataFrame(rows, "doc long, chunk int, idx int, start_logit double, end_logit double, is_short boolean, t string")
    out = {r.doc: (r.start, r.end, round(r.score, 9)) for r in S.dynamic_spans(logits, top, 0.9, longest, 4, 0.3).collect()}
    assert out == want


def test_caps_of_keys_and_tightened_spans(spark):
    body = "名  abc，de  f"
    tokens = [(0, 0, 1), (1, 1, 3), (2, 3, 6), (3, 6, 7), (4, 7, 9), (5, 9, 11), (6, 11, 12)]
    logits = spark.createDataFrame([(1, 0, i, 9.0 if i == 1 else 0.0, 9.0 if i == 3 else 0.0, True, cap) for i, *_ in tokens for cap in [3]], "doc long, chunk int, idx int, start_logit double, end_logit double, is_short boolean, cap int")
    spans = S.dynamic_spans(logits, 20, 0.9999, 128, 6, 0.2)
    assert [tuple(r)[2:4] for r in spans.collect()] == [(1, 3)]
    frame = spark.createDataFrame([(1, 0, *t) for t in tokens], "doc long, chunk int, idx int, s int, e int")
    texts = spark.createDataFrame([(1, 0, body, 5)], "doc long, chunk int, body string, start int")
    (r,) = S.tightened_spans(spans, frame, texts).collect()
    assert (r.start, r.end, r.char_start, r.char_end, r.text) == (2, 2, 3, 6, "abc")
    plain = spark.createDataFrame([(1, 0, 2, 4)], "doc long, chunk int, start int, end int")
    (r,) = S.tightened_spans(plain, frame, texts).collect()
    assert (r.start, r.end, r.text) == (2, 4, "abc，de")


def brute_layout(lines, limit):
    """Text of lines (words, left, right), broken once."""
    render = lambda some: re.sub(r"[ \t]+", " ", " ".join(w for w, *_ in some if w is not None)).strip()
    count = lambda w: len(TOKEN.findall(w or ""))
    n = len(lines)
    if sum(count(w) for w, *_ in lines) <= limit or n == 1:
        return render(lines)
    inked = [x for x in lines if x[0] and x[0].strip()]
    low, high = (min(x[1] for x in inked), max(x[2] for x in inked)) if inked else (0, 0)
    width = max(1, high - low)
    right_gap, indent = max(12, 0.2 * width), max(8, 0.12 * width)
    run = 0
    for i, (w, *_) in enumerate(lines):
        run += count(w)
        if run >= limit:
            near = min(i, n - 2)
            break
    period = lambda j: (lines[j][0] or "").rstrip().endswith("。")

    def natural(j):
        (w, _, r), (v, left, _) = lines[j], lines[j + 1]
        if w is None or v is None or not (w or v):
            return False
        numbered = re.match(r"\s*([0-9]+|[一二三四五六七八九十百千]+|[ivxlcdmIVXLCDM]+)", v)
        return max(0, high - r) > right_gap or period(j) and (max(0, left - low) <= indent or not numbered)

    order = [*range(near, n - 1), *range(near - 1, -1, -1)]
    at = next((j for j in order if natural(j)), next((j for j in order if period(j)), near))
    a, b = render(lines[: at + 1]), render(lines[at + 1 :])
    k = next((k for k in range(min(30, len(a), len(b)), 5, -1) if b.startswith(a[-k:])), 0)
    return f"{a}\n\n{b[k:]}".strip()


def test_layout_breaks_equal_plain_python(spark):
    rnd, rows, want = random.Random(9), [], {}
    pieces = ["患者 无异常。", "2. 检查", "ab cd", "很长的一行文字没有结尾", "", None, "iv 项", "脑转移随后继续。", "  ", "x\ty。 "]
    for doc in range(80):
        lines = [(rnd.choice(pieces), float(rnd.choice([0, 3, 30])), float(rnd.choice([90, 100, 60]))) for _ in range(rnd.randrange(1, 14))]
        if doc % 5 == 0 and len(lines) > 2:
            lines[1:3] = [("前文脑转移随后继续。", 0.0, 40.0), ("脑转移随后继续。又", 0.0, 100.0)]
        limit = rnd.choice([3, 8, 20])
        want[doc] = brute_layout(lines, 8)
        rows += [(doc, i, *x, "clash", limit) for i, x in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc long, line int, words string, left double, right double, at string, n int")
    assert {r.doc: r.text for r in L.layout_breaks(frame, 8).collect()} == want
    assert any("\n\n" in t for t in want.values()) and not all("\n\n" in t for t in want.values())


def test_line_helpers(spark):
    rows = [("甲（", "乙", False), ("甲", "）乙", False), ("a", "b", True), ("a ", "b", False), ("a", "\tb", False), ("", "b", False), (None, "b", False), ("a", "。", False)]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    for r in frame.select("want", L.needs_space(F.col("a"), F.col("b")).alias("got"), "a", "b").collect():
        assert bool(r.got) == r.want, r
    heads = [("1. 甲", True), (" 二、", True), ("ivy", True), ("甲1", False), (None, False), ("", False)]
    assert [r.x for r in spark.createDataFrame([(h,) for h, _ in heads], "h string").select(L.starts_numbered(F.col("h")).alias("x")).collect()] == [w for _, w in heads]


def test_top_similar_meets_blocks_as_matrices(spark):
    import math
    import random

    from spanlake.operators import curate as C

    rnd = random.Random(6)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(5)]) for i in range(90)] + [(90 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(30)]
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, 2.0]), (203, [1.0, None, 3.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = C.top_similar(df, df.filter("vec_id % 10 = 0 and vec_id < 200"), 4, block=5, tile=16)
    assert "mapinarrow" in out._jdf.queryExecution().optimizedPlan().toString().lower()

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in (*a, *b) or not any(a) or not any(b):
            return None
        return round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), 6)

    want = []
    for q, x in rows:
        if q % 10 == 0 and q < 200:
            s = [(cosine(x, y), v) for v, y in rows if v != q]
            s.sort(key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
            want += [(q, r + 1, v, c) for r, (c, v) in enumerate(s[:4])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_top_similar_of_odd_vectors_and_repeated_ids(spark):
    from spanlake.operators import curate as C

    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(150 + i, [rows[i % 3][1][0] + rnd.choice([0, 1e-9, 1e-7]), *rows[i % 3][1][1:]]) for i in range(60)]  # copies and all but copies
    rows += [(i, [x * 1e160 for x in rows[i][1]]) for i in range(4)] + [(220 + i, [x * 1e-165 for x in rows[i][1]]) for i in range(4)]
    rows += [(230, [math.inf, 1.0, 2.0, 3.0, 4.0, 5.0]), (231, [math.nan] * 6), (232, [1e308] * 6), (233, []), (234, [0.0] * 6), (235, [2.0]), (None, [1.0] * 6)]
    rows += [(240 + i, [rnd.gauss(0, 1) for _ in range(2)]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = C.top_similar(df, df, 4, block=16, tile=16, parts=3)

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return None
        s, x, y = 0.0, 0.0, 0.0
        for u, v in zip(a, b):
            s, x, y = s + u * v, x + u * u, y + v * v
        n = math.sqrt(y) * math.sqrt(x)
        return round(s / n, 6) + 0.0 if n and math.isfinite(s / n) else None

    want = []
    for q in sorted({i for i, _ in rows if i is not None}):
        s = [(cosine(x, y), v) for i, x in rows if i == q for v, y in rows if v != q and v is not None]
        s.sort(key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
        want += [(q, r + 1, v, c) for r, (c, v) in enumerate(s[:4])]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    named = df.filter("vec_id < 40").select(F.concat(F.lit("n"), "vec_id").alias("vec_id"), "embedding")
    assert C.top_similar(named, named.limit(5), 3, block=2, tile=8).count() == 3 * 5
