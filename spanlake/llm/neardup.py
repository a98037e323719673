"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has 48 symbols of 32 bits, one MinHash of its shingle set each, in 16 chunks of 3.  Two
signatures that differ in at most 29 symbols have a chunk with at most one differing symbol (pigeonhole), so they
share one of the 3 pairs of symbols of that chunk: each document is filed under 48 such pairs.  At a similarity of
0.75 a symbol differs with probability 1/4; more than 29 of 48 differ once in some ten million pairs.  A candidate is
also held against 144 further symbols: no more than 80 of all 192 may differ, which is as rarely exceeded (the tests
work out both tails), and spares documents of a similarity of one half or so their comparison on full sets.

Documents with equal sets (told by the SHA-256 of all their shingles' hashes) are one class, filed once.  Candidates are checked
on their full shingle sets.  Members of a bucket are first compared, under a few of their keys, with its centre, the member whose symbols
the others share most: that joins a group of copies with few checks each.  A bucket is dealt into blocks of bounded size
with a centre each, and these centres meet again.  What is left in different components is then compared within the
bucket: rows outside the bucket's largest component against all its rows, block by block.  Passing pairs aren't
emitted, only the homes (groups by nearest centre) that they lie between; the members of such homes meet once and are
compared on full sets.

Null and empty texts have no shingles and no links.  A text of fewer words than a shingle is one shingle.  Rows of one
id are one document, so their texts are linked; if ``row`` names a column that numbers the rows, each row is a document
of its own.  Classes that have null ids alone are linked with nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .components import components
from .sets import full_sets, set_digest, shingle_rows
from .tables import compacted, lean, materialize, prepare, release

SHINGLE, SYMBOLS, CHUNK = 5, 48, 3
#: Symbols in which two signatures may differ.
DISTANCE = 29
#: Further symbols, of 8 bits, and how many of all symbols agree at least.
FURTHER, AGREE = 144, 112
#: Sets of a centre's members that are checked together, and shingles of these, about.
HOME_ROWS, HOME_SHINGLES = 512, 1 << 17
#: Keys of a document under which it looks for a centre.
STAR_KEYS = 6
#: Rows of a bucket that meet in one place, about.
BLOCK_ROWS = 2048
#: Pairs of rows that are looked at together.
PAIRS = 1 << 17
#: Links need intersection * DEN >= union * NUM.
NUM, DEN = 75, 100


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    n = SYMBOLS + FURTHER
    x = T.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(T.MIX_2))
    return x[:n] | np.uint64(1), x[n:]


def sign(docs: DataFrame, size: int, row: str | None = None) -> DataFrame:
    """doc_id, n (set size), digest of the set (null if it is empty), the signature, and the column ``row`` if it is named."""
    own = [F.col(row).alias("row")] if row else []

    def scan(batches):
        mul, add = _multipliers()
        for b in batches:
            sets = list(shingle_rows(b.column("text"), size))
            n = np.array([len(s) for s in sets], np.int64)
            sig = np.zeros((len(n), SYMBOLS + FURTHER), np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                flat, at = np.concatenate(sets), np.r_[0, np.cumsum(n[full])[:-1]]
                step = 1 << 18  # cache-sized runs
                edges = np.searchsorted(at, np.arange(0, len(flat) + step, step))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo == hi:
                        continue
                    part = flat[at[lo] : at[hi] if hi < len(at) else len(flat)]
                    for j in range(SYMBOLS + FURTHER):
                        sig[full[lo:hi], j] = np.minimum.reduceat((part ^ add[j]) * mul[j], at[lo:hi] - at[lo])
            sig = T.mix(sig)
            short = np.hstack([(sig[:, :SYMBOLS] >> np.uint64(32)).astype("<u4").view(np.uint8), (sig[:, SYMBOLS:] >> np.uint64(56)).astype(np.uint8)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([x.tobytes() for x in short], pa.binary()), *b.columns[2:]],
                ["doc_id", "n", "digest", "sig", *(["row"] if row else [])],
            )

    return docs.select("doc_id", "text", *own).mapInArrow(lean(scan), "doc_id long, n long, digest binary, sig binary" + (", row long" if row else ""))


def _symbols(column: pa.Array, dtype="<u4") -> tuple[np.ndarray, np.ndarray]:
    """The symbols and the further ones."""
    at = SYMBOLS * np.dtype(dtype).itemsize
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, at + FURTHER)
    return np.ascontiguousarray(both[:, :at]).view(dtype), both[:, at:]


def _pair_keys(sig: np.ndarray) -> np.ndarray:
    """The keys a signature is filed under: for each chunk, its symbols with one left out."""
    out = np.empty((len(sig), SYMBOLS), np.uint64)
    for c in range(0, SYMBOLS, CHUNK):
        for left_out in range(CHUNK):
            i, j = (c + x for x in range(CHUNK) if x != left_out)
            out[:, c + left_out] = T.mix(((sig[:, i].astype(np.uint64) << np.uint64(32)) | sig[:, j]) ^ np.uint64((c + left_out + 1) * T.MIX_1 % 2**64))
    return out


def file_under(reps: DataFrame) -> DataFrame:
    """(rep, key) rows, 48 of each signature."""

    def scan(batches):
        for b in batches:
            keys = _pair_keys(_symbols(b.column("sig"))[0]) if b.num_rows else np.zeros((0, SYMBOLS), np.uint64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), SYMBOLS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), lists], ["rep", "keys"])

    return reps.select("rep", "sig").mapInArrow(lean(scan), "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))


def shortened(reps: DataFrame) -> DataFrame:
    """``reps`` with 16 bits of each symbol: equal symbols stay equal, so what these rule out the whole ones do."""

    def scan(batches):
        for b in batches:
            sig, further = _symbols(b.column("sig"))
            x = np.hstack([(sig >> np.uint32(16)).astype("<u2").view(np.uint8), further])
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([r.tobytes() for r in x], pa.binary())], ["rep", "n", "sig"])

    return reps.select("rep", "n", "sig").mapInArrow(lean(scan), "rep long, n long, sig binary")


def _by_unit(rows: DataFrame, columns: tuple[str, ...], work, schema: str) -> DataFrame:
    """``work(unit, *columns, symbols, further)`` over runs of whole units of ``rows``."""

    def scan(batches):
        held: list[list[np.ndarray]] = []  # rows of the last unit, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            now = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("unit", *columns)), *_symbols(b.column("sig"), "<u2")]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if held and held[-1][0][-1] != now[0][0]:
                yield work(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            if cut:
                yield work(*map(np.concatenate, zip(*held, [x[:cut] for x in now], strict=True)))
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield work(*map(np.concatenate, zip(*held, strict=True)))

    return rows.select("unit", *columns, "sig").repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(scan), schema)


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM


def _to_centre(unit, bucket, rep, n, sig, further) -> pa.RecordBatch:
    """(a, b, near, bucket): each member b of a unit with its centre a, whose symbols agree with most others' symbols; and the
    centre itself with its bucket.

    Counting equal symbols takes no pairs.
    """
    new = np.r_[True, unit[1:] != unit[:-1]]
    number = np.cumsum(new) - 1
    common = np.zeros(len(unit), np.int64)
    for j in range(SYMBOLS):
        _, which, count = np.unique((number.astype(np.uint64) << np.uint64(16)) | sig[:, j], return_inverse=True, return_counts=True)
        common += count[which]
    order = np.lexsort((rep, -common, number))
    first = order[np.flatnonzero(new)]
    centre = first[number]
    near = (sig == sig[centre]).sum(1)
    agree = near + (further == further[centre]).sum(1)
    ok = (rep != rep[centre]) & (near >= SYMBOLS - DISTANCE) & (agree >= AGREE) & _sizes_allow(n, n[centre])
    out = [np.r_[rep[centre][ok], rep[first]], np.r_[rep[ok], rep[first]], np.r_[agree[ok], np.zeros(len(first), np.int64)], np.r_[bucket[ok], bucket[first]]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "near", "bucket"])


def stars(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, near): members b of the buckets ``members(key, rep, members)`` that may be linked with their centres a."""
    schema = "a long, b long, near long, bucket long"
    block = F.when(F.col("members") > BLOCK_ROWS, F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK_ROWS))).otherwise(F.lit(0))
    rows = members.select(F.xxhash64("key", block).alias("unit"), "rep", F.when(F.col("members") > BLOCK_ROWS, F.col("key")).alias("bucket"))
    found = materialize(_by_unit(rows.join(reps, "rep").withColumn("bucket", F.coalesce("bucket", F.lit(0).cast("long"))), ("bucket", "rep", "n"), _to_centre, schema).filter("a <> b or bucket <> 0").distinct())
    # The centres of a large bucket's blocks are its members once more.
    again = found.filter("a = b").select(F.col("bucket").alias("unit"), F.lit(0).cast("long").alias("bucket"), F.col("a").alias("rep"))
    more = _by_unit(again.join(reps, "rep"), ("bucket", "rep", "n"), _to_centre, schema)
    out = materialize(found.unionByName(more).filter("a <> b").select("a", "b", "near").distinct())
    release(found)
    return out


def _may_link(i, j, n, label, sig, further) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) in different components whose sizes and signatures allow a link."""
    ok = (label[i] != label[j]) & _sizes_allow(n[i], n[j])
    i, j = i[ok], j[ok]
    near = (sig[i] == sig[j]).sum(1)
    ok = near >= SYMBOLS - DISTANCE
    i, j, near = i[ok], j[ok], near[ok]
    ok = near + (further[i] == further[j]).sum(1) >= AGREE
    return i[ok], j[ok]


def _across(unit, home, n, label, left, right, sig, further) -> pa.RecordBatch:
    """(a, b): homes of left and right rows of one unit, of different components, that may be linked."""
    rights, lefts = np.flatnonzero(right), np.flatnonzero(left)
    lo, hi = np.searchsorted(unit[rights], unit[lefts], "left"), np.searchsorted(unit[rights], unit[lefts], "right")
    counts = hi - lo
    steps = np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()) + PAIRS, PAIRS), "right")
    steps = np.unique(np.r_[0, steps, len(lefts)])
    out = [np.zeros((0, 2), np.int64)]
    for a, b in zip(steps[:-1], steps[1:], strict=True):
        c = counts[a:b]
        i = np.repeat(lefts[a:b], c)
        j = rights[np.repeat(lo[a:b] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(len(i))]
        i, j = _may_link(i, j, n, label, sig, further)
        out.append(np.unique(np.c_[np.minimum(home[i], home[j]), np.maximum(home[i], home[j])], axis=0))
    found = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def across(members: DataFrame, people: DataFrame) -> DataFrame:
    """(a, b): homes with members in one bucket of ``members(key, rep)`` that may be linked and aren't in one component.

    Rows outside a bucket's largest component meet all its rows, block by block.
    """
    labelled = members.select("key", "rep").join(people.select("rep", "label"), "rep")
    sizes = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.sum("count").alias("m"), F.max("count").alias("most")).filter("most < m")
    rows = members.select("key", "rep").join(sizes, "key").join(people.select("rep", "home", "n", "label", "sig"), "rep")
    minor = F.col("label") != F.col("top")
    a, b = (F.ceil(x / F.lit(BLOCK_ROWS)) for x in (F.col("m") - F.col("most"), F.col("m")))
    i, j = (F.pmod(F.xxhash64("rep"), x) for x in (a, b))
    at = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    wide = F.concat(
        F.transform(F.sequence(zero, a - 1), lambda x: at(x, j, no, yes)),
        F.when(minor, F.transform(F.sequence(zero, b - 1), lambda x: at(i, x, yes, no))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean,right:boolean>>")),
    )
    places = F.explode(F.when((a == 1) & (b == 1), F.array(at(zero, zero, minor, yes))).otherwise(wide)).alias("p")
    rows = rows.select("key", "home", "n", "label", "sig", places).select(F.xxhash64("key", "p.i", "p.j").alias("unit"), "home", "n", "label", "p.left", "p.right", "sig")
    return _by_unit(rows, ("home", "n", "label", "left", "right"), _across, "a long, b long").distinct()


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and common * DEN >= (len(x) + len(y) - common) * NUM


def confirmed(pairs: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A set isn't sent with each of its pairs, but once to each pair of homes(rep, home) that its pairs lie between.
    """
    at = pairs.select("a", "b").join(homes.toDF("a", "ha"), "a").join(homes.toDF("b", "hb"), "b")
    at = compacted(at.select("a", "b", F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("group")))
    needed = at.select("group", F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    rows = needed.select("group", "rep", F.lit(None).cast("long").alias("other"), "shingles").unionByName(
        at.select("group", F.col("a").alias("rep"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("shingles"))
    )

    def check(batches):
        group, held = None, {}
        for b in batches:
            a, o = [], []
            for g, r, other, x in zip(*(b.column(c).to_pylist() for c in ("group", "rep", "other", "shingles")), strict=True):
                if g != group:
                    group, held = g, {}
                if other is None:  # sets come before the pairs
                    held.setdefault(r, []).append(np.frombuffer(x, np.uint64))
                elif any(_similar(x, y) for x in held.get(r, ()) for y in held.get(other, ())):
                    a.append(r)
                    o.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(o, pa.int64())], ["a", "b"])

    out = materialize(rows.repartition("group").sortWithinPartitions("group", F.col("other").asc_nulls_first()).mapInArrow(lean(check), "a long, b long"))
    release(at)
    return out


def linked_across(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Links (a, b) between the members of ``pairs(a, b)`` of homes, of ``people(rep, home, n, label, sig, shingles)``.

    A home is one row, which goes once to each of its pairs; there, members of different components whose signatures
    allow it are compared on full sets.  Members found linked are one component from then on.
    """
    fields = ("rep", "n", "label", "sig", "shingles")
    packed = people.groupBy("home").agg(F.collect_list(F.struct(*fields)).alias("people"))
    at = pairs.select("a", "b", F.xxhash64("a", "b").alias("group"))
    at = at.select("group", "a", F.explode(F.array_distinct(F.array("a", "b"))).alias("home"), (F.col("a") == F.col("b")).alias("same"))
    rows = at.join(packed, "home").select("group", (F.col("home") == F.col("a")).alias("left"), "same", "people")

    def links(homes: list[tuple[bool, bool, pa.StructArray]]):
        rep, n, label = (np.concatenate([x.field(f).to_numpy() for *_, x in homes]) for f in fields[:3])
        sig, further = map(np.concatenate, zip(*(_symbols(x.field("sig"), "<u2") for *_, x in homes), strict=True))
        sets = [np.frombuffer(b, np.uint64) for *_, x in homes for b in x.field("shingles").to_pylist()]
        left, found = np.repeat([side for side, *_ in homes], [len(x) for *_, x in homes]), []
        mine, other = np.flatnonzero(left), np.flatnonzero(~left)
        for at, x in enumerate(mine):
            rest = mine[at + 1 :] if homes[0][1] else other
            for y in _may_link(np.full(len(rest), x), rest, n, label, sig, further)[1]:
                if label[x] != label[y] and _similar(sets[x], sets[y]):
                    found.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def scan(batches):
        group, held = None, []
        for b in batches:
            people, offs = b.column("people").flatten(), b.column("people").offsets.to_numpy()
            for i, (g, left, same) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "left", "same")), strict=True)):
                if held and g != group:
                    yield links(held)
                    held = []
                group = g
                held.append((left, same, people.slice(offs[i] - offs[0], offs[i + 1] - offs[i])))
        if held:
            yield links(held)

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lean(scan), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, class_id (smallest id with the same set), component_id, kept.

    ``row`` names a column of longs that numbers the rows; it is then returned as ``row``.
    """
    prepare(docs.sparkSession)
    signed = materialize(sign(docs, size, row))
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # Numbers are fixed once the table is written.
    classes = materialize(classes.filter("low is not null").withColumn("rep", F.monotonically_increasing_id()))
    reps = classes.select("rep", "n", "sig")

    filed = file_under(reps)
    shared = filed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = materialize(filed.join(shared, "key"))
    everyone = materialize(shortened(reps.join(members.select("rep").distinct(), "rep")))

    # The first keys of an order that all share: alike rows have some of these in common; what they don't find is left to ``across``.
    first = Window.partitionBy("rep").orderBy(F.xxhash64("key"))
    few = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= STAR_KEYS).drop("place")
    star = stars(few, everyone)
    # At home with the centre that it is most like; large homes are dealt into blocks.
    centres = star.groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("centre")).withColumnRenamed("b", "rep")
    blocks = centres.join(everyone.select("rep", "n"), "rep").groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / HOME_ROWS, F.sum("n") / HOME_SHINGLES)).alias("blocks"))
    centres = centres.join(blocks, "centre").select("rep", "centre", F.pmod(F.xxhash64("rep"), "blocks").alias("block"))
    homes = compacted(everyone.join(centres, "rep", "left").select("rep", F.xxhash64(F.coalesce("centre", "rep"), F.coalesce("block", F.lit(0).cast("long"))).alias("home")))
    wanted = classes.select("rep", "low", "digest").join(everyone.select("rep"), "rep", "left_semi")
    sets = materialize(full_sets(docs, wanted, size).withColumnRenamed("grams", "shingles"))
    links = confirmed(star, homes, sets)
    labels = components(links)

    of = homes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "home", F.coalesce("label", "rep").alias("label"))
    people = materialize(of.join(everyone, "rep"))
    more = materialize(across(members, people))
    new = linked_across(more, people.join(sets, "rep"))
    own = ["row"] if row else []
    some = signed.filter("n > 0").select("doc_id", "n", "digest", *own)
    classed = materialize(some.join(classes.select("digest", "low", "rep"), "digest", "left").drop("digest"))
    empty = compacted(signed.filter("n = 0").select("doc_id", "n", *own))
    if not row:
        of_id = classed.filter("doc_id is not null and rep is not null").select("doc_id", "rep").distinct()
        new = new.unionByName(of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")))
    new = materialize(new)
    if not new.isEmpty():
        labels = components(links.unionByName(new))
    release(signed, members, everyone, star, homes, sets, people, more)
    labelled = labels.withColumnRenamed("node", "rep").join(classes.select("rep", "low"), "rep")
    lowest = compacted(labelled.join(labelled.groupBy("label").agg(F.min("low").alias("lowest")), "label").select("rep", "lowest"))
    release(classes, links, new)
    out = classed.join(lowest, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("class_id"), F.coalesce("lowest", "low", "doc_id").alias("component_id"), *own)
    none = empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), *own)
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
