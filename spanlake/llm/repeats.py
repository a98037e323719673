"""Removal of repeated passages: longest-previous-factor arrays over suffix arrays.

The longest previous factor of a place tells how long a match begins there that also begins earlier.  Bytes covered by
matches of ``length`` bytes or more go, so the first copy stays.  No suffix array of the whole corpus is built: every
window of ``length`` bytes names an anchor, the smallest hash among the runs of ``gram`` bytes in it, so equal windows
name equal anchors.  Consecutive windows of one anchor form a segment.  Segments whose anchor occurs once are done;
the others are noted, by anchor, in a shard, which tells those that repeat an earlier one whole.  Only the texts of
anchors with several different segments meet again: there, suffixes are sorted and each suffix's previous factor is
found.  Equal segments are collapsed in their batch of documents before they are sent, so hot passages stay small.

Earlier means a smaller id (null first), or an earlier place in the same document; rows of one id count in the order
of their contents.  Null and empty texts have no bytes.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textscan as T
from .batches import gather, pack, unpack, with_replies
from .tables import bucketed, lean, materialize, prepare

LENGTH, GRAM = 100, 40
NOTE = np.dtype([("body", "<u8"), ("id", "<i8"), ("tie", "<u8"), ("start", "<i8"), ("windows", "<i4")])
#: What a shard says of a segment: it is the first of its anchor's only body; it repeats an earlier segment; its
#: anchor has several bodies, so its text is needed.
ALONE, REPEATED, OPEN = 0, 1, 2


def _make_batch(number: int, docs: pa.Table) -> pa.RecordBatch:
    """Documents in the order of (id, contents)."""
    text = docs.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
    ids = docs.column("doc_id").cast(pa.int64())
    null = ids.is_null().to_numpy()
    order_id = ids.fill_null(-(2**63)).to_numpy()
    tie = np.zeros(len(order_id), np.uint64)
    for c in T.chunks(text):
        p = T.prefix_sums(c.data)
        tie[c.first : c.first + c.rows] = T.mix((p[c.offs[1:]] - p[c.offs[:-1]]) * T.powers(len(c.data) + 1)[1][c.offs[:-1]])
    order = np.lexsort((tie, order_id))
    text = text.take(pa.array(order))
    sizes = pa.compute.binary_length(text).to_numpy().astype(np.int64)
    data = b"".join(text.to_pylist())
    rows = docs.column("row").to_numpy()[order] if "row" in docs.column_names else np.zeros(0, np.int64)
    cols = [pack(x) for x in (order_id[order], null[order], tie[order], sizes, rows)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *(pa.array([x], pa.binary()) for x in (*cols, pack(data)))], ["batch", "size", "ids", "nulls", "ties", "sizes", "rows", "text"])


def _segments(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, body hash, start, windows, document) of each segment of a batch, in order."""
    offs = np.r_[0, np.cumsum(sizes)]
    whole = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
    out = []
    for c in T.chunks(whole):
        n = len(c.data)
        if n < length:
            continue
        p, inverse = T.prefix_sums(c.data), T.powers(n + 1)[1]
        g = T.mix((p[gram:] - p[: n - gram + 1]) * inverse[: n - gram + 1])
        best = T.sliding_min(g, length - gram + 1)
        row = np.repeat(np.arange(c.rows, dtype=np.int32), np.diff(c.offs))
        inside = row[: len(best)] == row[length - 1 : length - 1 + len(best)]
        first = inside.copy()
        first[1:] &= ~((best[1:] == best[:-1]) & inside[:-1] & (row[1 : len(best)] == row[: len(best) - 1]))
        start = np.flatnonzero(first)
        windows = np.add.reduceat(inside.astype(np.int32), start) if len(start) else np.zeros(0, np.int32)
        end = start + windows + length - 1
        body = T.mix((p[end] - p[start]) * inverse[start] + windows.astype(np.uint64))
        out.append((g[best[start]], body, start + offs[c.first], windows, row[start].astype(np.int64) + c.first))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _first_of_equals(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first with its keys, in the order given."""
    order = np.lexsort(keys)  # stable
    first = np.zeros(len(keys[0]), bool)
    if len(order):
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        first[order[new]] = True
    return first


def previous_factors(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each of ``places`` (ascending) has ``length`` bytes or more.

    Suffixes are ranked by their first ``length`` bytes, by prefix doubling.  In suffix order, with equals by place,
    the previous smaller place of a suffix is its left neighbour wherever they share ``length`` bytes; the next smaller
    one never shares so many.  So the factor is that long exactly if the left neighbour has the same rank.
    """
    n = len(text)
    pad = np.concatenate([text, np.zeros(8, np.uint8)])
    pair = np.zeros(n, np.uint64)
    for i in range(8):
        pair <<= np.uint64(8)
        pair |= pad[i : i + n]
    span = 8
    while span < length:
        rank = _ranks(pair)
        step = span if 2 * span <= length else length - span
        if 2 * span >= length:  # the last: only the places asked for
            pair = rank[places].astype(np.uint64)
            pair <<= np.uint64(32)
            pair |= rank[places + step]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            found = np.zeros(len(places), bool)
            found[order[1:]] = pair[1:] == pair[:-1]
            return found
        pair = rank.astype(np.uint64)
        pair <<= np.uint64(32)
        pair[: max(0, n - step)] |= rank[step:]
        span += step
    raise ValueError("length must be over 8")


def _ranks(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones; ``values`` are sorted in place, so that they are held once."""
    order = np.argsort(values, kind="stable")
    values[:] = values[order]
    new = np.zeros(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.cumsum(new, dtype=np.uint32)
    return rank


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run; steps are summed in place, so nothing else is as long."""
    full = counts > 0
    starts, counts = starts[full].astype(np.int64), counts[full].astype(np.int64)
    ends = np.cumsum(counts)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
        np.cumsum(out, out=out)
    return out


#: Bytes of text whose suffixes are ranked at once; a shard with more is cut by anchor.
RANKED_BYTES = 1 << 20


def _judge(group: pa.Table) -> pa.Table:
    """For each noted segment of a shard ALONE, REPEATED or OPEN."""
    group = group.sort_by("batch")
    parts = [X.unpack_keys(b) for b in group.column("keys").to_pylist()]
    key, note = np.concatenate(parts), np.concatenate([unpack(b, NOTE) for b in group.column("vals").to_pylist()])
    order = np.lexsort((note["start"], note["tie"], note["id"]))
    first = np.zeros(len(key), bool)
    first[order] = _first_of_equals(note["body"][order], key[order])
    _, which, bodies = np.unique(key[first], return_inverse=True, return_counts=True)
    verdict = np.full(len(key), REPEATED, np.uint8)
    verdict[first] = np.where(bodies[which] > 1, OPEN, ALONE)
    cut = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({"batch": group.column("batch").cast(pa.int64()), "shard": group.column("shard").cast(pa.int32()), "vals": pa.array([pack(x) for x in np.split(verdict, cut)], pa.binary())})


def _rank(group: pa.Table, length: int) -> pa.Table:
    """For each window of the open segments of a shard, whether an earlier window equals it; packed bits."""
    group = group.sort_by("batch")
    parts = [X.unpack_keys(b) for b in group.column("keys").to_pylist()]
    key, blobs = np.concatenate(parts), [(unpack(b["note"], NOTE), unpack(b["text"], np.uint8)) for b in group.column("open").to_pylist()]
    note, text = np.concatenate([n for n, _ in blobs]), np.concatenate([t for _, t in blobs])
    windows = note["windows"].astype(np.int64)
    sizes = windows + length - 1
    place, at = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    order = np.lexsort((note["start"], note["tie"], note["id"]))
    seen = np.zeros(int(windows.sum()), bool)
    slices = max(1, -(-int(sizes.sum()) // RANKED_BYTES))
    share = (key[order] >> np.uint64(3)) % np.uint64(slices)
    for s in range(slices):
        own = order[share == np.uint64(s)]
        if len(own):
            begin = np.cumsum(sizes[own]) - sizes[own]
            seen[_flat(at[own], windows[own])] = previous_factors(text[_flat(place[own], sizes[own])], _flat(begin, windows[own]), length)
    counts = [int(n["windows"].sum()) for n, _ in blobs]
    bits = [pack(np.packbits(x)) for x in np.split(seen, np.cumsum(counts)[:-1])]
    return pa.table({"batch": group.column("batch").cast(pa.int64()), "shard": group.column("shard").cast(pa.int32()), "vals": pa.array(bits, pa.binary())})


class _Noted:
    """A batch's noted segments (key, place, windows, note) and those that repeat one of its own batch."""

    def __init__(self, r: dict):
        self.key, self.note = X.unpack_keys(r["keys"]), unpack(r["notes"], NOTE)
        self.place, self.later = unpack(r["places"], np.int64), unpack(r["later"], np.int64).reshape(-1, 2)
        self.windows = self.note["windows"].astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, spans (removed runs of bytes), kept (the rest).

    ``row`` names a column of longs that tells rows of one id apart; it is then returned as ``row``.
    """
    import pyarrow.compute  # noqa: F401

    prepare(docs.sparkSession)
    own = [F.col(row).alias("row")] if row else []
    batched = bucketed(gather(docs.select("doc_id", "text", *own), ["doc_id", "text", *(["row"] if row else [])], _make_batch, "batch long, size long, ids binary, nulls binary, ties binary, sizes binary, rows binary, text binary"), "batch")
    shards = X.shard_count(batched.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 8 << 20)

    def ask(rows):
        for b in rows:
            for r in b.to_pylist():
                key = _segments(unpack(r["text"], np.uint8), unpack(r["sizes"], np.int64), length, gram)[0]
                key, count = np.unique(key, return_counts=True)
                yield X.requests(r["batch"], key, count.astype(np.uint32).view([("n", "<u4")]), shards)

    counts = X.sum_by_key(batched.select("batch", "sizes", "text").mapInArrow(lean(ask), X.REQUEST), [("n", "<u4")], [("n", "<u4")])

    def note(rows):
        """The segments whose anchors occur again, once each in a batch."""
        for b in rows:
            for r in b.to_pylist():
                sizes = unpack(r["sizes"], np.int64)
                key, body, start, windows, doc = _segments(unpack(r["text"], np.uint8), sizes, length, gram)
                known = np.unique(key)
                n = X.answers(r["parts"], known, shards, [("n", "<u4")])["n"]
                again = n[np.searchsorted(known, key)] > 1
                key, body, start, windows, doc = (x[again] for x in (key, body, start, windows, doc))
                first = _first_of_equals(body, key)
                own = np.zeros(int(first.sum()), NOTE)
                base = np.cumsum(sizes) - sizes
                own["body"], own["windows"], own["start"] = body[first], windows[first], start[first] - base[doc[first]]
                own["id"], own["tie"] = unpack(r["ids"], np.int64)[doc[first]], unpack(r["ties"], np.uint64)[doc[first]]
                cols = [X.pack_keys(key[first]), pack(own), pack(start[first].astype(np.int64)), pack(np.c_[start[~first], windows[~first]].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["batch", "keys", "notes", "places", "later"])

    noted = bucketed(with_replies(batched, counts).mapInArrow(lean(note), "batch long, keys binary, notes binary, places binary, later binary"), "batch")

    def send(rows):
        for b in rows:
            for r in b.to_pylist():
                x = _Noted(r)
                yield X.requests(r["batch"], x.key, x.note, shards)

    verdicts = materialize(noted.select("batch", "keys", "notes", "places", "later").mapInArrow(lean(send), X.REQUEST).groupBy("shard").applyInArrow(_judge, X.REPLY))

    def send_open(rows):
        for b in rows:
            for r in b.to_pylist():
                x, data = _Noted(r), unpack(r["text"], np.uint8)
                open_ = np.flatnonzero(X.answers(r["verdicts"], x.key, shards, np.uint8) == OPEN)
                for s, ix in enumerate(X.split(x.key[open_], shards)):
                    if len(ix):
                        ix = open_[ix]
                        body = {"note": pack(x.note[ix]), "text": pack(data[_flat(x.place[ix], x.windows[ix] + length - 1)])}
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([r["batch"]], pa.int64()), pa.array([X.pack_keys(x.key[ix])], pa.binary()), pa.array([body], pa.struct([("note", pa.binary()), ("text", pa.binary())]))], ["shard", "batch", "keys", "open"])

    known = with_replies(noted, verdicts, "verdicts")
    texts = batched.select("batch", "text").join(known, "batch").mapInArrow(lean(send_open), "shard int, batch long, keys binary, open struct<note:binary,text:binary>")
    found = texts.groupBy("shard").applyInArrow(lambda g: _rank(g, length), X.REPLY)

    def finish(rows):
        for b in rows:
            for r in b.to_pylist():
                data, sizes, x = unpack(r["text"], np.uint8), unpack(r["sizes"], np.int64), _Noted(r)
                verdict = X.answers(r["verdicts"], x.key, shards, np.uint8)
                gone = np.zeros(len(data), bool)
                gone[_flat(x.later[:, 0], x.later[:, 1])] = True
                repeated = verdict == REPEATED
                gone[_flat(x.place[repeated], x.windows[repeated])] = True
                open_ = np.flatnonzero(verdict == OPEN)
                bits = {p["shard"]: p["vals"] for p in r["found"] or []}
                for s, ix in enumerate(X.split(x.key[open_], shards)):
                    if len(ix):
                        places = _flat(x.place[open_[ix]], x.windows[open_[ix]])
                        gone[places[np.unpackbits(unpack(bits[s], np.uint8), count=len(places)).astype(bool)]] = True
                out = _cut(r, data, sizes, gone, length)
                yield out.append_column("row", pa.array(unpack(r["rows"], np.int64))) if row else out

    ready = batched.join(with_replies(known, found, "found"), "batch").select("batch", "ids", "nulls", "sizes", "rows", "text", "keys", "notes", "places", "later", "verdicts", "found")
    return ready.mapInArrow(lean(finish), "doc_id long, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary" + (", row long" if row else ""))


def _cut(r: dict, data: np.ndarray, sizes: np.ndarray, gone: np.ndarray, length: int) -> pa.RecordBatch:
    """The rows of a batch, in which the windows that begin where ``gone`` is set are removed."""
    total = np.cumsum(gone, dtype=np.int32)
    covered = gone.copy()
    covered[:length] = total[:length] > 0
    covered[length:] = total[length:] > total[:-length]
    del total
    offs = np.r_[0, np.cumsum(sizes)]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = covered[:-1], covered[1:]
    before[offs[:-1][sizes > 0]] = False
    after[offs[1:][sizes > 0] - 1] = False
    begin, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    bound = np.searchsorted(begin, offs)
    removed = np.zeros(len(data) + 1, np.int32)
    np.cumsum(covered, dtype=np.int32, out=removed[1:])
    removed = removed[offs].astype(np.int64)
    left = offs - removed
    doc = np.repeat(np.arange(len(sizes)), np.diff(bound))
    span = pa.StructArray.from_arrays([pa.array(begin - offs[doc]), pa.array(end - offs[doc])], ["first", "end"])
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(left), pa.py_buffer(data[~covered])])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(unpack(r["ids"], np.int64), mask=unpack(r["nulls"], bool)),
            pa.array(sizes),
            pa.array(np.diff(removed)),
            pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), span),
            kept.cast(pa.binary()),
        ],
        ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
    )
