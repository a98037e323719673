"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries the
best score and the number of pieces of the best path.  Scores add up in 64 bits.  The tie rule is the tokenizer's: of
paths of equal score into a character, the one whose last piece begins first stays.  A character that is no piece of
its own may count as unknown, at ten below the lowest score, and is spelled in bytes.

A text is put as ``\\u2581`` and the text with each space as ``\\u2581``.  No piece has that mark behind another
character, so the best path never crosses such a place, and words are counted alone, once as long as a worker
remembers them; with a vocabulary that does cross, texts are counted whole.  Null and empty texts have no tokens.
Every row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import prepare

MARK = "▁"
#: Scores below the lowest piece for an unknown character (fixed value of the tokenizer).
UNKNOWN_BELOW = 10.0
REMEMBERED = 600_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a model file and their scores; control, unknown and byte pieces never match a text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        crosses = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.words = (lambda t: [t]) if crosses else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Pieces of the best path through ``text``."""
        n = len(text)
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        odd = deque(() if self.single.issuperset(text) else (e for e, c in enumerate(text, 1) if c not in self.single))

        def unknown(e: int) -> None:
            if score[e - 1] + self.unknown > score[e]:
                score[e], count[e] = score[e - 1] + self.unknown, count[e - 1] + len(text[e - 1].encode())

        # Matches come by their end, longest first: the earliest start stays on equal scores.
        for end, (length, s) in self.automaton.iter(text):
            end += 1
            while odd and odd[0] < end:
                unknown(odd.popleft())
            if score[end - length] + s > score[end]:
                score[end], count[end] = score[end - length] + s, count[end - length] + 1
        for e in odd:
            unknown(e)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        words = self.words(MARK + text.replace(" ", MARK))
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    known[w] = n
            total += n
        if len(known) > REMEMBERED:
            known.clear()
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens."""
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(read_pieces(path))  # a file of fixed size

    def scan(batches):
        if path not in _counters:
            _counters[path] = Counter(vocabulary.value)
        count = _counters[path].text
        for b in batches:
            n = np.fromiter((count(t) if t else 0 for t in b.column("text").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_tokens long")
