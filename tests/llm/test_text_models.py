"""Decontamination, language, toxicity, tokens and the language model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from spanlake.llm import bpe, katz, langid, textscan, tokencount, toxicity
from spanlake.llm.decontaminate import decontaminate
from spanlake.llm.tables import remainder

from .conftest import ITEM

LOWER = {c: c + 32 for c in range(65, 91)}
PLAIN, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes(rows):
    texts = [t for _, t, *_ in rows]
    for kind, pattern in (("plain", PLAIN), ("spaced", SPACED)):
        seen = {}
        for c in textscan.chunks(pa.array(texts), 500):
            w = textscan.words(c, kind)
            for r in range(c.rows):
                lo, hi = w.bounds[r], w.bounds[r + 1]
                found = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi])]
                assert found == pattern.findall((texts[c.first + r] or "").translate(LOWER))
                for word, h in zip(found, w.hash[lo:hi].tolist()):
                    assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_decontamination_equals_brute_force(spark, docs, rows):
    items = [(7, ITEM), (10, "Three word item"), (9, None), (8, ""), (11, "one two"), (12, " ".join(ITEM.split()[2:14])), (7, ITEM)]
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    want = Counter()
    for i, t, *_ in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, of = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    of |= windows[k]
        want[i, len(w), len(hit), tuple(sorted(of)), bool(hit)] += 1
    out = decontaminate(spark, docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in out) == want
    assert sum(e - s for r in out for s, e in r.spans) == sum(r.n_hit for r in out) > 0


def test_decontamination_without_items_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(spark, docs, none).collect())
    assert decontaminate(spark, no_docs, none).collect() == []


def test_language(docs, no_docs, rows):
    out = langid.identify(docs, F.lit(True)).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) >= {"doc_id", "lang_pred", "score", "key"}
    pred = {r.doc_id: r for r in out}
    assert [pred[i].lang_pred for i in (2, 3, 4, 21)] == ["und"] * 4
    assert [pred[i].lang_pred for i in (23, 24, 25)] == ["de", "de", "en"]
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.identify(no_docs, F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_language_equals_brute_force(spark, docs, rows):
    """Multinomial naive Bayes over hashed n-grams of 1 to 3 characters, counted and added up one by one."""

    def buckets(text):
        x = [ord(y) if len(y := ch.lower()) == 1 else ord(ch) for ch in ("".join(ch if ch.isalpha() else " " for ch in text))]
        for n in (1, 2, 3):
            for i in range(len(x) - n + 1):
                h = n
                for v in x[i : i + n]:
                    h = ((h ^ v) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                yield h & (langid.BUCKETS - 1)

    training = [(i, t, lang) for i, t, lang in rows if lang is not None and (i or 0) % 2 == 0]
    langs = sorted({lang for *_, lang in training})
    counts = {x: Counter(b for _, t, lang in training if lang == x for b in buckets(t or "")) for x in langs}
    of, want = Counter(lang for *_, lang in training), Counter()
    for i, t, _ in rows:
        if not any(ch.isalpha() for ch in t or ""):
            want[i, "und", 0.0] += 1
            continue
        z = {x: np.log(of[x] / len(training)) for x in langs}
        for b in buckets(t):
            for x in langs:
                z[x] += np.log((counts[x][b] + langid.SMOOTHING) / (sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS))
        best = max(langs, key=lambda x: z[x])
        want[i, best, round(1 / sum(np.exp(z[x] - z[best]) for x in langs), 6)] += 1
    out = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(docs, F.col("doc_id") % 2 == 0).collect())
    assert out == want and len({x for _, x, _ in want}) > 2


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(1, "abc", "xx"), (2, "abc", "aa"), (3, "abc", None), (4, "zzz", None), (5, "abc " * 500_000, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, F.lit(True)).collect()}
    assert out[3] == out[4] == ("aa", 0.5) and out[5][0] == "aa"


def test_toxicity_learns_words_and_pairs(spark):
    rnd = np.random.default_rng(3)
    data = []
    for i in range(900):
        words = [f"w{x}" for x in rnd.integers(0, 300, 20)]
        insult, group = i % 3 == 0, i % 2 == 0
        data.append((i, " ".join(words + ["fool"] * insult + ["them"] * group), int(insult and group)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(3)
    m = toxicity.train(docs, docs.filter("doc_id % 5 > 0").withColumn("extra", F.lit(1)))
    out = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    held = [(out[i] >= 0.5) == bool(y) for i, _, y in data if i % 5 == 0]
    assert sum(held) / len(held) > 0.95
    assert np.mean([out[i] for i, _, y in data if y == 0 and i % 3 == 0]) < 0.5  # the insult alone


def test_toxicity_learns_pairs_of_terms_that_are_neutral_alone(spark):
    rnd = np.random.default_rng(5)
    data = []
    for i, (a, b) in enumerate((rnd.random((1500, 2)) < 0.5).tolist()):
        words = [f"w{x}" for x in rnd.zipf(1.4, 20) % 300]
        data.append((i, " ".join(words + ["fool"] * a + ["them"] * b), int(a != b)))
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, docs.filter("doc_id % 5 > 0"))).collect()}
    held = [(out[i] >= 0.5) == bool(y) for i, _, y in data if i % 5 == 0]
    assert sum(held) / len(held) > 0.95


def test_toxicity_pairs_equal_brute_force():
    rnd = np.random.default_rng(11)
    x = rnd.random((4500, 6)) < [0.5, 0.4, 0.3, 0.2, 0.1, 0.001]
    y = ((x[:, 0] ^ x[:, 2]) & (rnd.random(4500) < 0.9)).astype(float)
    row, which = np.nonzero(x)
    want = np.zeros(6, bool)
    for i in range(6):
        for j in range(i):
            cells = [y[(x[:, i] == u) & (x[:, j] == v)] for u, v in ((1, 1), (1, 0), (0, 1), (0, 0))]
            if min(map(len, cells)) >= toxicity.PAIR_ROWS:
                a, b, c, d = (k.mean() for k in cells)
                spread = (y.mean() * (1 - y.mean()) * sum(1 / len(k) for k in cells)) ** 0.5
                if abs(a - b - c + d) >= toxicity.PAIR_DEVIATION * spread:
                    want[[i, j]] = True
    assert want[0] and want[2] and not want.all()
    assert toxicity.interacting(which, row, x.sum(0), y).tolist() == want.tolist()


def test_toxicity_edge_cases(docs, no_docs, rows, spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.train(no_docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(no_docs, None).collect() == []


def test_bpe_equals_library(docs, no_docs, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    out = bpe.tokenize(docs, path, P.PATTERN).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.tokenize(no_docs, path, P.PATTERN).collect() == []


def test_bpe_decode_and_long_words():
    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(tokens)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    ids = [np.array([50, 60, 40000, 7], "<u4").tobytes(), b"", np.arange(300, dtype="<u4").tobytes()]
    assert codec.decode(ids) == [b"".join(tokens[i] for i in np.frombuffer(x, "<u4")) for x in ids]
    for word in ("ab" * 400, "the" * 200, "é中" * 150):
        assert codec.encode([word.encode()])[0] == np.array(library._core_bpe.encode_single_piece(word.encode()), "<u4").tobytes()


def test_token_counts_equal_library(docs, no_docs, rows):
    path = P.path("piece_bpe_32k.model")
    pieces = tokencount.read_pieces(path)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", 0.0) for i in range(256))], 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    out = tokencount.count_tokens(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert tokencount.count_tokens(no_docs, path).collect() == []


def test_token_count_ties_and_crossing_pieces():
    c = tokencount.Counter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b▁c", -1.0)])
    assert c.word("aaaa") == 2  # equal scores: the earliest start of the last piece stays
    assert c.text("ab c") == c.word("▁ab▁c")


def test_katz_equals_brute_force(docs, rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows}
    toks = {k: [*SPACED.findall((t or "").translate(LOWER)), None] for k, (i, t, *_) in enumerate(rows)}
    uni, pair = Counter(), Counter()
    for k, (i, *_) in enumerate(rows):
        if not held[i]:
            uni.update(toks[k])
            pair.update(zip(["<s>", *toks[k][:-1]], toks[k]))
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    d = katz.discounts(Counter(pair.values()))
    kept = lambda c: c * (d[c] if c <= 5 else 1.0)
    seen, low, context = defaultdict(float), defaultdict(float), Counter()
    for (a, b), c in pair.items():
        seen[a] += kept(c)
        low[a] += p(b)
        context[a] += c

    def prob(a, b):
        if not context[a]:
            return p(b)
        total = context[a] + (1 if seen[a] >= context[a] - 1e-9 else 0)
        if pair[a, b]:
            return kept(pair[a, b]) / total
        return (1 - seen[a] / total) / (1 - low[a]) * p(b)

    for a in ("<s>", *list(uni)[:20]):  # sums to one over known words and one unknown
        if a is not None:
            assert math.isclose(sum(prob(a, b) for b in uni) + prob(a, "never seen"), 1, rel_tol=1e-9)
    out = katz.score(docs, remainder("doc_id", 10) == 0).collect()
    want = Counter()
    for k, (i, *_) in enumerate(rows):
        t = toks[k]
        base, score = sum(math.log10(p(w)) for w in t), sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *t[:-1]], t))
        want[i, held[i], len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out) == want


def test_discounts_lie_between_0_and_1_whatever_is_missing():
    full = {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6}
    assert np.allclose(katz.discounts(full)[1:], [((r + 1) * full[r + 1] / (r * full[r]) - 0.36) / 0.64 for r in range(1, 6)])
    for odd in ({}, {1: 5}, {1: 100, 3: 20, 5: 8}, {2: 9, 4: 9}, {r: 10 for r in range(1, 7)}, {r: r for r in range(1, 7)}, {**full, 4: 0}):
        d = katz.discounts(odd)
        assert d[0] == 1 and ((d[1:] > 0) & (d[1:] < 1)).all() and (np.diff(d[1:]) > 0).all(), odd
    line = katz.discounts({r: round(1e9 * r**-2.5) for r in (1, 2, 4, 5, 6)})  # one is missing on a straight line
    whole = katz.discounts({r: round(1e9 * r**-2.5) for r in range(1, 7)})
    assert np.allclose(line, whole, atol=1e-3)


def test_katz_of_nothing(no_docs, spark):
    assert katz.score(no_docs, F.lit(False)).collect() == []
    r = katz.score(spark.createDataFrame([(None, None)], "doc_id long, text string"), F.lit(True)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (1, 0, 0, 0.0, 0.0)


def test_toxicity_scores_equal_brute_force(spark, docs, rows):
    rng = np.random.default_rng(2)
    terms = [next(toxicity.terms(pa.array([t]))) if t else np.zeros(0, np.uint64) for _, t, *_ in rows]
    known = np.unique(np.concatenate(terms))[::2]
    m = toxicity.Machine(known, rng.normal(0, 0.3, len(known)), rng.normal(0, 0.3, (len(known), toxicity.FACTORS)), -0.2)
    place = {int(t): i for i, t in enumerate(known)}
    want = Counter()
    for (i, *_), ts in zip(rows, terms, strict=True):
        own = [place[int(t)] for t in ts if int(t) in place]
        z = m.bias + sum(m.weight[a] for a in own) + sum(float(m.factor[a] @ m.factor[b]) for k, a in enumerate(own) for b in own[:k])
        want[i, round(1 / (1 + math.exp(-z)) if z > -700 else 0.0, 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, m).collect()) == want


def test_bpe_worker_remembers_a_bounded_number_of_words():
    from spanlake.llm.bpe import Codec

    codec, most, learned = Codec.__new__(Codec), 0, []
    codec.young, codec.old = {}, {}
    codec.encode, codec.decode = lambda words: learned.append(len(words)) or words, lambda ids: ids
    for lo in range(0, 600_000, 20_000):
        words = [str(i) for i in range(lo, lo + 20_000)]
        assert [x for x, _ in codec.known(words)] == [w.encode() for w in words]
        most = max(most, len(codec.young) + len(codec.old))
    assert most <= 240_000 and max(learned) <= 12_000
