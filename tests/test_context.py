"""A scorer's context, and cuts at keys with blank lines behind them."""

import hashlib
import re

from spanlake.operators import fold as D
from spanlake.operators.context import scorer_contexts

TOKEN = re.compile(r"[一-鿿]|[A-Za-z0-9]+|[^\w\s]")


def test_contexts_hold_query_neighbours_and_examples(spark):
    structure = spark.createDataFrame([("t", k, i) for i, k in enumerate("abcde")], "title string, key string, ord int")
    aliases = spark.createDataFrame([("t", "a", "x", 0), ("t", "a", "y", 1), ("u", "a", "z", 0), ("t", "c", "w", 0), ("u", "d", "x", 5)], "title string, key string, alias string, ord int")
    records = spark.createDataFrame([(1, 0, "t", "x", "1"), (1, 1, "t", "b", "2"), (1, 2, "t", "d", "4"), (2, 0, "", "q", "9")], "id long, ord int, title string, key string, value string")
    hits = spark.createDataFrame([(1, 2, "second" * 9), (1, 1, "first"), (1, 3, "third"), (7, 1, "other")], "id long, rank int, text string")
    out = {(r.id, r.key): (r.query, r.around, r.examples) for r in scorer_contexts(records, structure, aliases, hits, k=2, shown=10).collect()}
    assert out == {
        (1, "x"): ("t x x z y", "", ["first", "secondseco…"]), (1, "b"): ("t b", "a：1；d：4", ["first", "secondseco…"]),
        (1, "d"): ("t d", "b：2", ["first", "secondseco…"]), (2, "q"): ("q", "", []),
    }


def brute_cuts(text, keys, budget):
    count = lambda x: len(TOKEN.findall(x))
    if not text:
        return []
    if count(text) <= budget:
        return [(0, len(text))]
    cuts = [0]
    for at in sorted({m.start() for k in keys if k for m in re.finditer(f"(?={re.escape(k)})", text)}):
        if at > cuts[-1] and count(text[cuts[-1] : at]) > budget:
            cuts.append(at)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        if count(text[a:b]) <= budget:
            out.append((a, b))
            continue
        for part in text[a:b].split("\n\n"):
            if part:
                out.append((a, a + len(part)))
            a += len(part) + 2
    return out


def test_what_keys_leave_too_long_is_cut_at_blank_lines(spark):
    texts = ["a b c d\n\ne f KEY g h i\n\n\n\nj k l m KEY n", "one two three four five\n\nsix", "short KEY", "KEY a b c d e f g h", "x\n\ny", "", None, "a b c d e f g\n\n"]
    rows = [(i, t, ["KEY", ""], 1) for i, t in enumerate(texts)]
    out = D.cut_at_keys(spark.createDataFrame(rows, "doc_id long, text string, keys array<string>, start int"), 3).collect()
    got = {i: [(r.start, r.end) for r in sorted(out, key=lambda r: r.chunk) if r.doc_id == i] for i, *_ in rows}
    assert got == {i: brute_cuts(t, ["KEY"], 3) for i, t in enumerate(texts)}
    assert all(texts[r.doc_id][r.start : r.end] == r.body for r in out)


def test_every_order_with_a_vector_has_examples(spark, tmp_path):
    import math

    from spanlake import plans

    vectors = [(i, [math.cos(i * i), math.sin(i * i)]) for i in range(1, 60)] + [(60, None), (61, [0.0, 0.0]), (70, [1.0, 1.0])]
    texts = {i: f"text {i} " + "x" * (i * 10) for i, _ in vectors if i != 7}
    tables = {
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
        "documents": spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        "lineitem": spark.createDataFrame([(i, 1, 5, i % 3, 1.0, "A") for i in (*range(1, 62), 99)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
        "part": spark.createDataFrame([(5, "brand", "name", "type", 1)], "p_partkey long, p_brand string, p_name string, p_type string, p_size int"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r.id: (r.n, r.examples) for r in plans.QUERIES["j3_contexts"](spark, str(tmp_path)).collect()}

    def want(i):
        own = dict(vectors).get(i)
        if not own or not any(own):
            return []
        scores = [(-round(sum(x * y for x, y in zip(own, v)), 5), j) for j, v in vectors if j != i and v and any(v)]
        scores = [(s / math.sqrt(2) if j == 70 else s, j) for s, j in scores]
        return [texts[j] if len(texts[j]) <= 500 else texts[j][:500] + "…" for _, j in sorted(scores)[:3] if j in texts]

    assert out == {i: (len(w := want(i)), hashlib.md5("|".join(w).encode()).hexdigest()) for i in (*range(1, 62), 99)}
    assert sum(n == 3 for n, _ in out.values()) > 50 and [out[i][0] for i in (60, 61, 99)] == [0, 0, 0]
