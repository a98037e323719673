"""Words and hashes of whole Arrow text columns, vectorised over chunks of a few MB.

A word's hash is ``sum(T[byte] * B^i) mod 2^64`` over its bytes, mixed; it comes from prefix sums, so no word is
handled alone.  Hashes only find candidates or stand for words where 64 bits are plenty; exact steps compare texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial hash, its inverse modulo 2^64 and the multipliers of the finalizer (fixed values).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


@cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[k] = x
    return _powers[0][:n], _powers[1][:n]


@cache
def fold_table() -> np.ndarray:
    """Lower-cases A-Z, leaves other bytes."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


@cache
def word_table(kind: str) -> np.ndarray:
    """Which (lower-cased) bytes belong to words: ``spaced`` words end at white space, ``plain`` ones are 0-9, a-z and non-ASCII."""
    t = np.ones(256, bool)
    if kind == "spaced":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        for a, b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            t[a : b + 1] = False
    return t


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j] times BASE^i."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data))[0], out=p[1:])
    return p


@dataclass
class Chunk:
    """Some rows: ``data`` their bytes, ``offs`` where each row begins (and the end), ``first`` the first row's number."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Rows of a text (or binary) column in runs of about ``size`` bytes; null is empty."""
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, len(a))
        yield Chunk(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    data: np.ndarray  #: lower-cased bytes of the chunk
    start: np.ndarray  #: of each word, in data
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  #: words of row r are bounds[r]:bounds[r + 1]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(chunk: Chunk, kind: str) -> Words:
    data = fold_table()[chunk.data]
    inside = word_table(kind)[data]
    full = chunk.offs[:-1][np.diff(chunk.offs) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(full):
        before[full] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    ends = chunk.offs[1:][np.diff(chunk.offs) > 0]
    if len(ends):
        after[ends - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    p = prefix_sums(data)
    inverse = powers(len(data) + 1)[1]
    return Words(data, start, end, mix((p[end] - p[start]) * inverse[start]), np.searchsorted(start, chunk.offs))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive hashes; shorter than ``hashes`` by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(BASE) + hashes[j : j + n]
    return mix(g + np.uint64(k))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)
        a, b = v[: len(v) - step], v[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        v = np.where(right, b, a)
        span += step
    return at[:n].astype(np.int64)
