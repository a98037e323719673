"""The corpus pipeline against brute force, stage by stage."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from spanlake.llm import bpe

from .conftest import ITEM, WORDS
from .test_dedup import LOWER, brute_components, brute_repeats

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, lang, f"s{i}", len(t or "")) for i, t, lang in rows if i is not None]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute(rows):
    kept = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    _, group = brute_components(kept)
    kept = [(i, t) for i, t in kept if group[i] == i]
    cut = {(i, n): b for i, n, gone, _, b in brute_repeats(kept) if gone}
    kept = [(i, cut[i, len(t.encode())].decode("utf-8", "ignore") if (i, len(t.encode())) in cut else t) for i, t in kept]
    kept = [(i, t) for i, t in kept if t]
    item = PLAIN.findall(ITEM.translate(LOWER))
    windows = {tuple(item[s : s + 10]) for s in range(len(item) - 9)}
    return [(i, t) for i, t in kept if not any(tuple(w[s : s + 10]) in windows for w in [PLAIN.findall(t.translate(LOWER))] for s in range(len(w) - 9))]


def test_pipeline_equals_brute_force(spark, sf_dir, rows):
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = Counter()
    for i, t in brute(rows):
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and 0 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.collect() == []


def test_each_row_has_its_own_decision(spark, sf_dir):
    """Repeated ids and null ids, in stages that once decided by id."""

    def after(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return Counter((r.doc_id, r.text) for r in stage(spark, docs.repartition(2), sf_dir).collect())

    a, b, c = (" ".join(WORDS[k::4]) for k in (0, 1, 2))
    n = min(map(len, (a, b)))
    a, b = a[: n - 1] + "x", b[: n - 1] + "y"  # of one length, over 100 bytes
    near, passages, benchmark = (getattr(corpus_pipeline, x) for x in ("near_duplicates", "repeated_passages", "benchmark_passages"))
    assert after(near, [(1, a), (2, a), (2, c), (None, a), (None, c), (None, b)]) == Counter([(1, a), (2, c), (None, b)])
    assert after(passages, [(7, a), (7, a), (8, c)]) == Counter([(7, a), (8, c)])
    assert after(passages, [(1, a), (2, f"{a}"), (2, b), (None, c), (None, c)]) == Counter([(1, a), (2, b), (None, c)])
    hit = f"{c} {ITEM} {c}"
    assert after(benchmark, [(None, hit), (None, a), (3, hit), (3, b)]) == Counter([(None, a), (3, b)])


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
