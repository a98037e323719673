"""Exact search and URL rules against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import urlfilter
from spanlake.llm.queries import URL_RULES
from spanlake.llm.topk import search


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_search_equals_brute_force(spark, scale):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-scale, scale) for _ in range(40)]) for i in range(400)]
    rows += [(400, rows[50][1]), (401, rows[50][1]), (402, None), (403, [None] * 40), (404, [float("nan")] * 40), (405, [float("inf")] * 40), (450, [1.0] * 3), (451, [2.0] * 3), (None, [0.5] * 40)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, dims string, score int").repartition(5)
    got = {tuple(r) for r in search(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute(rows, 5)


def test_query_rows_of_one_id_have_lists_of_their_own(spark):
    up, down = [float(i) for i in range(1, 9)], [float(-i) for i in range(1, 9)]
    rows = [(50, [1.0]), (50, [1.0]), (50, [-1.0]), *((i, [v]) for i, v in enumerate(up + down, 1))]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 50, 5).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == sorted([*((k, 9 - k) for k in range(1, 6)), *((k, 9 - k) for k in range(1, 6)), *((k, 17 - k) for k in range(1, 6))])


def test_very_large_components_and_scores(spark):
    """Scaled components count as 2^53 at most, scores as 2^63 - 1; scores beyond are ties, which go to the smaller id."""
    rows = [(50, [1e12, 1.0]), (1, [1e12, 5.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [0.0, 3.0]), (5, [1.7e308, -1.7e308]), (100, [2.0, 1e7])]
    clamp = lambda x, most: max(-most, min(most, x))
    whole = {i: [clamp(math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(2**53, x)), 2**53) for x in v] for i, v in rows}
    want = set()
    for i in (50, 100):
        scores = sorted((-clamp(sum(a * b for a, b in zip(whole[i], v)), 2**63 - 1), j) for j, v in whole.items() if j != i)
        want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:4])}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in search(df, F.col("vec_id") % 50 == 0, 4).collect()} == want


def test_search_of_nothing(spark):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect() == []


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h), len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow")))


URLS = [None, "", "no scheme", "http://", "http://COM/", "https://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/q", "http://example.com?x/en/", "http://net/es/", "ftp://a.b.net/fr/x", "http://net/de/", "http://x.com", "http://xcom/", "http://example.com/e", "http://..com/", "a://b://c.com/", "http://ünï.net/es/é"]


def test_url_rules_equal_brute_force(spark):
    rnd = random.Random(1)
    urls = URLS + [f"http://{'.'.join(rnd.choice(['a', 'www', 'example', 'net', 'com']) for _ in range(rnd.randint(1, 4)))}/{rnd.choice(['en/', 'es/', 'fr/', '', 'e'])}{i}" for i in range(300)] + URLS[:3]
    df = spark.createDataFrame([(i, u, "k", "v") for i, u in enumerate(urls)], "page_id long, url string, keys string, verdict string").repartition(3)
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, URL_RULES).collect()}
    assert out == {i: brute_url(u) for i, u in enumerate(urls)}


def test_hosts_of_very_many_labels(spark):
    urls = [f"http://{'a.' * 20_000}{end}" for end in ("com/x", "example.com/en/", "net/fr/", "org/")]
    out = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES).collect()}
    for i, u in enumerate(urls):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == brute_url(u)


def test_cascade_is_exact_and_has_another_way(spark, monkeypatch):
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)  # many wrong answers, so many levels
    levels = urlfilter.build(listed, universe, spark)
    assert len(levels) > 2
    frame = universe.select(F.array("key").alias("keys"))
    got = {r.hit for r in urlfilter.with_members(frame, levels, "hit").collect() if r.hit}
    assert got == {f"k{i}" for i in range(500)}
    monkeypatch.setattr(urlfilter, "MAX_BITS", 1)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, URL_RULES).collect()} == {i: brute_url(u) for i, u in enumerate(URLS)}


def test_urls_of_nothing(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []


def test_rows_of_files_are_numbered_in_place(spark, tmp_path):
    from spanlake.llm.tables import numbered

    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 7 as file", "'x' as row").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    once, again = ({(r.id, r.row) for r in numbered(docs.filter("id % 3 = 0"), "id").repartition(n).collect()} for n in (2, 9))
    assert once == again and len({r for _, r in once}) == len(once) == 334
    written = numbered(docs.groupBy("id").count(), "id")
    assert written.select("row").distinct().count() == 1000 and {r.id for r in written.collect()} == set(range(1000))
    assert numbered(docs.limit(0), "id").collect() == []
