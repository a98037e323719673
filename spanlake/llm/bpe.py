"""Byte-level BPE encoding and decoding by recursive queries.

Each task asks an in-process DuckDB: token-position rows of the words join the merge table, the leftmost pair of the
lowest rank of each word is contracted, and this recurs until no word has a pair left.  Between rounds a word is a
string with one character per token.  Decoding joins (row, place, id) rows with the vocabulary and aggregates the
bytes in order.  Each distinct word is encoded, and its ids decoded, once as long as a task remembers it.  Words of
over 256 bytes would take a round per merge, and each round all places of the word; they are contracted from a heap, in
the same order (README has figures).

The vocabulary is a file of fixed size, so it is broadcast.  Null is the empty text, which has no tokens.  Every row
gives a row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .tables import give_back, lean, prepare

#: Words of a generation that a worker remembers; it keeps two, and a word that is used again moves to the younger one.
GENERATION = 100_000
#: Words of one recursive query; its rounds' rows are what it takes memory for.
LEARNED = 12_000
#: Text that is looked at together.
STEP_BYTES = 2 << 20
LONG = 256
#: Over any place in a word.
PLACES = 1 << 20

ENCODE = f"""
WITH RECURSIVE step(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM words
    UNION
    SELECT word, substr(tokens, 1, best % {PLACES} - 1) || chr((best // {PLACES})::INT) || substr(tokens, best % {PLACES} + 2)
    FROM (
        SELECT word, any_value(tokens) AS tokens, min(merged * {PLACES} + place) AS best
        FROM (SELECT word, tokens, unnest(range(1, length(tokens))) AS place FROM step WHERE length(tokens) > 1) AS positions
        JOIN merges ON merges.pair = substr(positions.tokens, place, 2)
        GROUP BY word
    )
)
SELECT tokens FROM step ORDER BY word
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY place) AS piece FROM positions JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def character(i: int) -> str:
    """A character for a token, in the order of ranks: from U+0001 on, without the surrogates."""
    return chr(i + 1 if i + 1 < 0xD800 else i + 0x801)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of ranks, by rank; None where a rank is missing."""
    with open(path, "rb") as f:
        found = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    return [found.get(i) for i in range(max(found) + 1)]


class Codec:
    """The tables of one vocabulary in a worker's DuckDB, and what it has encoded lately."""

    def __init__(self, tokens: list[bytes]):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.rank = {t: i for i, t in enumerate(tokens) if t is not None}
        self.character = {i: character(i) for i in self.rank.values()}
        self.id = {c: i.to_bytes(4, "little") for i, c in self.character.items()}
        pairs = [(a, b, i) for t, i in self.rank.items() for cut in range(1, len(t)) if (a := self.rank.get(t[:cut])) is not None and (b := self.rank.get(t[cut:])) is not None]
        self.byte = [self.character[self.rank[bytes([b])]] for b in range(256)]
        merged = pa.array([ord(self.character[i]) for *_, i in pairs], pa.int64())  # lower ranks first
        self._load("merges", pa.table({"pair": [self.character[a] + self.character[b] for a, b, _ in pairs], "merged": merged}))
        # Bytes as text, one character each, for the ordered aggregation.
        self._load("vocabulary", pa.table({"id": pa.array(list(self.rank.values()), pa.int64()), "piece": pa.array([t.decode("latin-1") for t in self.rank])}))
        self.young: dict[str, tuple[bytes, bytes]] = {}  # matches of the pattern: ids, decoded
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("loading", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")

    def _long(self, word: bytes) -> bytes:
        part, after, before = [word[i : i + 1] for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(word) and (r := self.rank.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        heap: list[tuple[int, int, bytes, bytes]] = []
        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(word) or part[j] != b:
                continue  # contracted meanwhile
            part[i], part[j], after[i] = a + b, b"", after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return b"".join(self.rank[x].to_bytes(4, "little") for x in part if x)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers.  A word that is itself a token is not split."""
        whole = [self.rank.get(w) for w in words]
        todo = [w for w, r in zip(words, whole, strict=True) if r is None and len(w) <= LONG]
        out = iter(())
        if todo:
            byte = self.byte
            self._load("words", pa.table({"word": np.arange(len(todo)), "tokens": ["".join([byte[b] for b in w]) for w in todo]}))
            found = self.db.execute(ENCODE).fetchnumpy()["tokens"]
            out = iter([b"".join([self.id[c] for c in x]) for x in found])
        return [r.to_bytes(4, "little") if r is not None else next(out) if len(w) <= LONG else self._long(w) for w, r in zip(words, whole, strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids."""
        doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        out = [b""] * len(ids)
        if len(flat):
            self.db.register("positions", pa.table({"doc": doc, "place": np.arange(len(flat)), "id": flat}))
            got = self.db.execute(DECODE).fetchnumpy()
            self.db.unregister("positions")
            for d, piece in zip(got["doc"].tolist(), got["piece"], strict=True):
                out[d] = piece.encode("latin-1")
        return out

    def known(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each of the distinct ``words``, remembered or learnt."""
        found = list(map(self.young.get, words))
        for at in [at for at, x in enumerate(found) if x is None] if self.old else ():
            found[at] = self.old.get(words[at])
        fresh = [at for at, x in enumerate(found) if x is None]
        for lo in range(0, len(fresh), LEARNED):
            some = fresh[lo : lo + LEARNED]
            ids = self.encode([words[at].encode() for at in some])
            for at, pair in zip(some, zip(ids, self.decode(ids), strict=True), strict=True):
                found[at] = pair
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        self.young.update(zip(words, found, strict=True))
        return found

    def close(self) -> None:
        self.db.close()
        self.__dict__.clear()


#: Texts with white space beside a space, at an end, or with U+0000; matches may reach over a space of these.
SPACE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = rf" [{SPACE}]|[{SPACE}] |\A[{SPACE}]|[{SPACE}]\z|\x00"


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The texts cut before each space."""
    return pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")


def _matches(pieces: pa.Array, find) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The matches in all pieces, where each piece's begin among them, and the pieces' places in that order.

    Pieces that begin with a space come first, as one text, since no match reaches over such a space.
    """
    first = pc.starts_with(pieces, " ")
    spaced, others = pieces.filter(first), pieces.filter(pc.invert(first)).to_pylist()
    found = find("".join(spaced.to_pylist()))
    ends = np.cumsum(pc.utf8_length(spaced).to_numpy(zero_copy_only=False))
    bounds = np.searchsorted(np.cumsum(list(map(len, found))), ends, "right")
    alone = [find(p) for p in others]
    order = np.argsort(~first.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bounds = np.r_[0, bounds, len(found) + np.cumsum(list(map(len, alone)), dtype=np.int64)].astype(np.int64)
    return found + [w for ws in alone for w in ws], bounds, place


def _strung(values: pa.Array, which: pa.Array, bounds: np.ndarray) -> pa.Array:
    """For each row the bytes of ``values`` that ``which[bounds[row]:bounds[row + 1]]`` names, in order."""
    taken = values.take(which)
    offs = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    data = taken.buffers()[2] if len(taken) else None
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs[bounds])), data if data is not None else pa.py_buffer(b"")])


def encode_texts(texts: pa.Array, known: Codec, find) -> tuple[pa.Array, pa.Array]:
    """The ids and the decoded bytes of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.match_substring_regex(texts, WHITE)
    even, rest = texts.filter(pc.invert(odd)), texts.filter(odd).to_pylist()
    cut = _pieces(even)
    spelled = cut.flatten().dictionary_encode()
    matches, piece_bounds, place = _matches(spelled.dictionary, find)
    spelled = pa.array(place[spelled.indices.to_numpy()])
    own = [find(t) for t in rest]
    all_words = pa.array([*matches, *(w for ws in own for w in ws)], pa.large_string()).dictionary_encode()
    pairs = known.known(all_words.dictionary.to_pylist())
    order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    out = []
    offs = np.asarray(cut.offsets) - (cut.offsets[0].as_py() if len(cut) else 0) if len(cut) else np.zeros(1, np.int64)
    for part in (0, 1):
        values = pa.array([p[part] for p in pairs], pa.large_binary())
        pieces = _strung(values, all_words.indices[: len(matches)], piece_bounds)
        both = [_strung(pieces, spelled, offs), _strung(values, all_words.indices[len(matches) :], np.r_[0, np.cumsum([len(ws) for ws in own], dtype=np.int64)])]
        out.append(pa.concat_arrays(both).take(pa.array(order)))
    return out[0], out[1]


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes)."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(read_ranks(path))

    def scan(batches) -> Iterator[pa.RecordBatch]:
        import regex

        known, find = Codec(vocabulary.value), regex.compile(pattern).findall
        try:
            yield from spelt(batches, known, find)
        finally:
            known.close()  # an executor keeps more workers than it has tasks

    def spelt(batches, known: Codec, find) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                before = int(sizes[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + STEP_BYTES, "right")))
                ids, decoded = encode_texts(b.column("text").slice(lo, hi - lo), known, find)
                n = pc.divide(pc.binary_length(ids), pa.scalar(4, pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), n.cast(pa.int64()), ids.cast(pa.binary()), decoded.cast(pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
                lo = hi
                del ids, decoded
                give_back()  # a step's words and queries leave holes that the next ones don't fill

    return docs.select("doc_id", "text").mapInArrow(lean(scan), "doc_id long, n_tokens long, ids binary, decoded binary")
