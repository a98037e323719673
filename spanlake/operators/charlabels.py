"""Labels of characters and tokens of whole texts, in Arrow batches of one row for each text: no character becomes a row before it is asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands for a missing place: no text is as long.
MISSING = np.iinfo(np.int64).max


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """The number of the text of each element, and the elements."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()


def _numbers(x: pa.Array, missing: int = MISSING) -> np.ndarray:
    return x.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def _labelled(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Text, place and label number (-1: null) of each labelled character of entities ``e`` in texts of length ``n``, in this order; labels."""
    own = b.column("n").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.full(b.num_rows, -1, np.int64)
    if own.any():
        length[own > 0] = _numbers(b.column("n").flatten().field("length"))[(np.cumsum(own) - own)[own > 0]]
    doc, e = _flat(b.column("e"))
    place = lambda c: (lambda x: np.where(x == MISSING, 0, np.maximum(0, x)))(np.minimum(_numbers(e.field(c)), length[doc]))
    a, z = place("start"), place("end")
    types = e.field("type").dictionary_encode()
    kind = _numbers(types.indices, -1)
    rank = pc.rank(e.field("ord"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.where(e.field("ord").is_valid().to_numpy(zero_copy_only=False), kind, -1)
    count = np.where(own[doc] > 0, np.maximum(0, z - a), 0)
    i = np.repeat(np.arange(len(doc)), count)
    pos = a[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    code = np.where(kind[i] < 0, -1, kind[i] * 3 + np.where(pos == z[i] - 1, 1, np.where(pos == a[i], 0, 2)))
    order = np.lexsort((rank[i], pos, doc[i]))
    doc, pos, code = doc[i][order], pos[order], code[order]
    last = np.r_[(doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]), True][: len(doc)]
    return doc[last], pos[last], code[last], [f"{p}-{t}" for t in types.dictionary.to_pylist() for p in "BEI"]


def _names(code: np.ndarray, labels: list[str]) -> pa.Array:
    return pa.array(labels, pa.string()).take(pa.array(code, pa.int64(), mask=code < 0))


def characters(batches):
    """(doc, pos, label) of rows (doc, e, n)."""
    for b in batches:
        doc, pos, code, labels = _labelled(b)
        yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(doc)), pa.array(pos, pa.int64()), _names(code, labels)], ["doc", "pos", "label"])


def _of_tokens(b: pa.RecordBatch, doc, pos, code, labels: list[str]) -> pa.RecordBatch:
    """(doc, idx, label) of the tokens ``t``, from characters in order of text and place."""
    kinds = {k: i for i, k in enumerate(dict.fromkeys(x[2:] for x in labels))}
    first = {p: np.array([x.startswith(p) for x in labels] + [False]) for p in ("B-", "E-", "I-")}
    kind = np.array([kinds[x[2:]] for x in labels] + [-1], np.int64)
    none, names = len(labels), [*labels, "O", *("B-" + k for k in kinds)]
    tdoc, t = _flat(b.column("t"))
    idx, s, e = (_numbers(t.field(c)) for c in ("idx", "s", "e"))
    known = (s != MISSING) & (e != MISSING)
    s, e = np.where(known, s, 0), np.where(known, e, 0)
    low = min([0, *(int(x.min()) for x in (pos, s, e) if len(x))])
    wide = max([0, *(int(x.max()) for x in (pos, s, e) if len(x))]) - low + 1
    key = lambda d, x: d * wide + (x - low)
    at, begin, end = key(doc, pos), key(tdoc, s), key(tdoc, e)
    out = np.full(len(tdoc), none, np.int64)
    for p in ("I-", "E-", "B-"):  # later ones overwrite
        some = first[p][code]  # a null label's number is that of no label
        own, number = at[some], code[some]
        if len(own):
            i = np.searchsorted(own, end) - 1 if p == "E-" else np.searchsorted(own, begin)
            inside = (i >= 0) & (i < len(own))
            i = np.where(inside, i, 0)
            inside &= (own[i] >= begin) & (own[i] < end)
            out = np.where(inside, number[i], out)
    order = np.lexsort((idx, tdoc))
    tdoc, idx, out = tdoc[order], t.field("idx").take(pa.array(order)), out[order]
    before = np.r_[none, np.where(tdoc[1:] == tdoc[:-1], out[:-1], none)][: len(out)]
    runs = (before != none) & ~first["E-"][before] & (kind[before] == kind[out])
    out = np.where(first["I-"][out] & ~runs, none + 1 + kind[out], out)
    return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(tdoc)), idx, _names(out, names)], ["doc", "idx", "label"])


def tokens_of_entities(batches):
    """(doc, idx, label) of rows (doc, t, e, n)."""
    for b in batches:
        yield _of_tokens(b, *_labelled(b))


def tokens_of_characters(batches):
    """(doc, idx, label) of rows (doc, t, c)."""
    for b in batches:
        doc, c = _flat(b.column("c"))
        named = c.field("label").dictionary_encode()
        pos, code = _numbers(c.field("pos")), _numbers(named.indices, -1)
        order = np.lexsort((pos, doc))
        yield _of_tokens(b, doc[order], pos[order], code[order], named.dictionary.to_pylist())
