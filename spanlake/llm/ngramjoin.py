"""A Jaccard self-join of word n-gram sets by rare-first prefix filtering.

The n-grams of a set are ordered by how frequent they are in the corpus (counted in 2^20 buckets, over all rows), rare
ones first, then by hash.  Two sets that are similar enough share an n-gram of their prefixes, the first
``n - ceil(0.85 n) + 1``.  So each set is filed under its prefix; lists of one are dropped.  Two sets of a list are
candidates if their sizes allow it (length filter), if what follows the shared n-gram in both can still hold the
overlap (positional filter), and if the sizes of their parts, in 128 ranges of the hashes, don't differ by more than the
sets may (suffix filter; the ranges are fixed pivots, so it takes 128 bytes of a set).  Candidates are confirmed on full
sets, once per pair.

Sets that are equal (told by the SHA-256 of all their n-grams' hashes) are one class and filed once.  Components are
asked for, not pairs, so a list isn't paired off: first, its members meet the one that is most like their mean, in blocks
of bounded size whose centres meet again; what these links leave in different components then meets within the list, rows
outside its largest component against all its rows, block by block.  Passing pairs aren't emitted, only the homes (groups
by nearest centre) that they lie between; the members of such homes meet once and are compared on full sets.  No link
between different sets is lost: every pair that shares a prefix n-gram is either in one component already or held
against the filters.

Null and empty texts have no n-grams and no links.  A text of fewer words than an n-gram is one n-gram.  Rows of one id
are one document, so their texts are linked; classes that have null ids alone are linked with nothing.  Very long texts
are whole rows of a scan, with some 100 bytes held for each of their words.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as T
from .batches import pack, unpack
from .components import components
from .sets import full_sets, set_digest, shingle_rows
from .tables import lean, materialize, prepare, release

GRAM = 4
#: Links need intersection * DEN >= union * NUM.
NUM, DEN = 85, 100
#: Counters of the frequency order, and the rows that one task sends them in.
BUCKETS, SLICES = 1 << 20, 64
#: Ranges of the suffix filter.
PARTS = 128
#: Rows of a list that meet in one place, about, and pairs that are looked at together.
BLOCK_ROWS, PAIRS = 2048, 1 << 16
#: Pairs whose parts are compared together.
STEP = 1 << 13
#: Lists of a set in which it looks for a centre.
STAR_LISTS = 3
#: Sets of a centre's members that are checked together, and n-grams of these, about.
HOME_ROWS, HOME_GRAMS = 512, 1 << 17


def prefix_length(n: np.ndarray | int):
    return n - (n * NUM + DEN - 1) // DEN + 1


def gram_order(docs: DataFrame, size: int) -> np.ndarray:
    """For each bucket of n-grams a 16-bit code that rises with their number in all rows."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for c in T.chunks(b.column("text")):
                w = T.words(c, "spaced")
                g = T.grams(w.hash, size)
                whole = w.row[: len(g)] == w.row[size - 1 : size - 1 + len(g)]
                total += np.bincount((g[whole] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pack(x) for x in np.split(total, SLICES)], pa.binary())], ["slice", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(unpack(b, np.int64) for b in group.column("counts").to_pylist())
        return pa.table({"slice": group.column("slice").slice(0, 1).cast(pa.int32()), "counts": pa.array([pack(total)], pa.binary())})

    found = docs.select("text").mapInArrow(lean(count), "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").toArrow()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for s, b in zip(found.column("slice").to_pylist(), found.column("counts").to_pylist(), strict=True):
        out[s] = unpack(b, np.int64)
    return (np.log2(out.ravel() + 1.0) * 1024).astype(np.uint16)


def rare_first(grams: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sorted distinct n-grams, rare ones first."""
    code = order[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    return grams[np.argsort((code << np.uint64(48)) | (grams >> np.uint64(16)), kind="stable")]


def describe(docs: DataFrame, order: np.ndarray, size: int) -> DataFrame:
    """doc_id, n (set size), digest of the set, its prefix and the sizes of its parts (up to 255)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def scan(batches):
        order = shared.value
        for b in batches:
            out = []
            for g in shingle_rows(b.column("text"), size):
                n = len(g)
                parts = np.minimum(255, np.bincount((g >> np.uint64(57)).astype(np.int64), minlength=PARTS)).astype(np.uint8)
                out.append((n, set_digest(g), rare_first(g, order)[: prefix_length(n)].tobytes(), parts.tobytes()) if n else (0, None, None, None))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(cols[0], pa.int64()), *[pa.array(x, pa.binary()) for x in cols[1:]]], ["doc_id", "n", "digest", "prefix", "parts"])

    return docs.select("doc_id", "text").mapInArrow(lean(scan), "doc_id long, n long, digest binary, prefix binary, parts binary")


def file_under(classes: DataFrame) -> DataFrame:
    """(rep, pos, key): the prefix of each class, n-gram by n-gram."""

    def scan(batches):
        for b in batches:
            prefix = b.column("prefix").to_pylist()
            offs = np.r_[0, np.cumsum([len(x) // 8 for x in prefix])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(prefix), np.int64)))], ["rep", "keys"])

    return classes.select("rep", "prefix").mapInArrow(lean(scan), "rep long, keys array<long>").select("rep", F.posexplode("keys").alias("pos", "key"))


def _fits(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) may be similar enough, by sizes, positions of their shared n-gram, and parts."""
    x, y = n[i], n[j]
    need = -(-NUM * (x + y) // (NUM + DEN))
    ok = (np.minimum(x, y) * DEN >= np.maximum(x, y) * NUM) & (np.minimum(x - pos[i], y - pos[j]) >= need)
    at = np.flatnonzero(ok)
    for some in np.split(at, range(STEP, len(at), STEP)):
        apart = np.abs(parts[i[some]].astype(np.int16) - parts[j[some]]).sum(1, dtype=np.int64)
        ok[some] = apart <= (x + y - 2 * need)[some]
    return ok


def _by_unit(rows: DataFrame, columns: tuple[str, ...], work, schema: str) -> DataFrame:
    """``work(unit, *columns, parts)`` over runs of whole units of ``rows``."""

    def scan(batches):
        held: list[list[np.ndarray]] = []  # rows of the last unit, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            parts = np.frombuffer(b"".join(b.column("parts").to_pylist()), np.uint8).reshape(-1, PARTS)
            now = [*(b.column(c).to_numpy(zero_copy_only=False) for c in ("unit", *columns)), parts]
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

    return rows.select("unit", *columns, "parts").repartition("unit").sortWithinPartitions("unit").mapInArrow(lean(scan), schema)


STAR = "a long, b long, key long, pos int, members long, apart long"


def _to_centre(unit, key, rep, n, pos, members, parts) -> pa.RecordBatch:
    """(a, b, key, pos, blocks, apart): each member b of a unit that may be linked with its centre a; of a list in several blocks also (a, a).

    ``apart`` is how far the sizes of their parts differ.

    The centre is the member whose parts are nearest to the unit's mean: finding it takes no pairs.
    """
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, len(unit)])
    number = np.repeat(np.arange(len(starts)), sizes)
    x = parts.astype(np.float32)
    mean = np.add.reduceat(x, starts, axis=0) / sizes[:, None].astype(np.float32)
    far = np.abs(x - mean[number]).sum(1)
    first = np.lexsort((rep, far, number))[starts]
    centre = first[number]
    ok = (rep != rep[centre]) & _fits(np.arange(len(rep)), centre, n, pos, parts)
    again = first[members[first] > BLOCK_ROWS]
    apart = np.abs(parts[ok].astype(np.int16) - parts[centre[ok]]).sum(1, dtype=np.int64)
    cols = [np.r_[rep[centre][ok], rep[again]], np.r_[rep[ok], rep[again]], np.r_[key[ok], key[again]], np.r_[pos[ok], pos[again]], -(-np.r_[members[ok], members[again]] // BLOCK_ROWS), np.r_[apart, np.zeros(len(again), np.int64)]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "key", "pos", "members", "apart"])


def stars(members: DataFrame, people: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, apart): members b of the lists ``members(key, rep, pos, members)`` that may be linked with their centres a; and the tables it reads."""
    level, tables = members, []
    pairs = None
    while True:
        block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / BLOCK_ROWS))
        rows = level.join(people, "rep").withColumn("unit", F.xxhash64("key", block))
        found = materialize(_by_unit(rows, ("key", "rep", "n", "pos", "members"), _to_centre, STAR))
        tables.append(found)
        mine = found.filter("a <> b").select("a", "b", "apart")
        pairs = mine if pairs is None else pairs.union(mine)
        # The centres of a long list's blocks are a list once more.
        level = found.filter("a = b").select("key", F.col("a").alias("rep"), "pos", "members")
        if level.isEmpty():
            return pairs.distinct(), tables


def homes_of(star: DataFrame, people: DataFrame) -> DataFrame:
    """(rep, home): a set is at home with the centre that it is most like, or alone; large homes are dealt into blocks."""
    centres = star.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("centre")).withColumnRenamed("b", "rep")
    blocks = centres.join(people.select("rep", "n"), "rep").groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / HOME_ROWS, F.sum("n") / HOME_GRAMS)).alias("blocks"))
    centres = centres.join(blocks, "centre").select("rep", "centre", F.pmod(F.xxhash64("rep"), "blocks").alias("block"))
    return people.select("rep").join(centres, "rep", "left").select("rep", F.xxhash64(F.coalesce("centre", "rep"), F.coalesce("block", F.lit(0).cast("long"))).alias("home"))


def _across(unit, home, n, pos, label, left, right, parts) -> pa.RecordBatch:
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
        ok = label[i] != label[j]
        i, j = i[ok], j[ok]
        ok = _fits(i, j, n, pos, parts)
        i, j = home[i[ok]], home[j[ok]]
        out.append(np.unique(np.c_[np.minimum(i, j), np.maximum(i, j)], axis=0))
    found = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def across(members: DataFrame, people: DataFrame) -> DataFrame:
    """(a, b): homes of ``people(rep, home, n, label, parts)`` with members in one list that may be linked and aren't in one component.

    Rows outside a list's largest component meet all its rows, block by block.
    """
    labelled = members.select("key", "rep").join(people.select("rep", "label"), "rep")
    sizes = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.sum("count").alias("m"), F.max("count").alias("most")).filter("most < m")
    rows = members.select("key", "rep", "pos").join(sizes, "key").join(people, "rep")
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
    rows = rows.select("key", "home", "n", "pos", "label", "parts", places).withColumn("unit", F.xxhash64("key", "p.i", "p.j")).select("unit", "home", "n", "pos", "label", "p.left", "p.right", "parts")
    return _by_unit(rows, ("home", "n", "pos", "label", "left", "right"), _across, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and common * DEN >= (len(x) + len(y) - common) * NUM


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough.  A set goes once to each group of its pairs; those of one set are dealt into 64."""
    at = materialize(pairs.withColumn("group", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(64)))))
    needed = at.select("group", F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    rows = needed.select("group", "rep", F.lit(None).cast("long").alias("other"), "grams").unionByName(at.select("group", F.col("a").alias("rep"), F.col("b").alias("other"), F.lit(None).cast("binary").alias("grams")))

    def check(batches):
        group, held = None, {}
        for b in batches:
            a, o = [], []
            for g, r, other, x in zip(*(b.column(c).to_pylist() for c in ("group", "rep", "other", "grams")), strict=True):
                if g != group:
                    group, held = g, {}
                if other is None:  # sets come before the pairs
                    held[r] = np.frombuffer(x, np.uint64)
                elif similar(held[r], held[other]):
                    a.append(r)
                    o.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(o, pa.int64())], ["a", "b"])

    out = materialize(rows.repartition("group").sortWithinPartitions("group", F.col("other").asc_nulls_first()).mapInArrow(lean(check), "a long, b long"))
    release(at)
    return out


def linked_across(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """Links (a, b) between the members of ``pairs(a, b)`` of homes, of ``people(rep, home, n, label, parts, grams)``.

    A home is one row, which goes once to each of its pairs; there, members of different components whose sizes and parts
    allow it are compared on full sets.  Members found linked are one component from then on.
    """
    fields = ("rep", "n", "label", "parts", "grams")
    packed = people.groupBy("home").agg(F.collect_list(F.struct(*fields)).alias("people"))
    at = pairs.select("a", "b", F.xxhash64("a", "b").alias("group"))
    at = at.select("group", "a", F.explode(F.array_distinct(F.array("a", "b"))).alias("home"), (F.col("a") == F.col("b")).alias("same"))
    rows = at.join(packed, "home").select("group", (F.col("home") == F.col("a")).alias("left"), "same", "people")

    def links(homes: list[tuple[bool, bool, pa.StructArray]]):
        rep, n, label = (np.concatenate([x.field(f).to_numpy() for *_, x in homes]) for f in fields[:3])
        parts = np.frombuffer(b"".join(b for *_, x in homes for b in x.field("parts").to_pylist()), np.uint8).reshape(-1, PARTS)
        sets = [np.frombuffer(b, np.uint64) for *_, x in homes for b in x.field("grams").to_pylist()]
        left, found, anywhere = np.repeat([side for side, *_ in homes], [len(x) for *_, x in homes]), [], np.zeros(len(rep), np.int64)
        mine, other = np.flatnonzero(left), np.flatnonzero(~left)
        for at, x in enumerate(mine):
            rest = mine[at + 1 :] if homes[0][1] else other
            rest = rest[label[rest] != label[x]]
            for y in rest[_fits(np.full(len(rest), x), rest, n, anywhere, parts)]:
                if label[x] != label[y] and similar(sets[x], sets[y]):
                    found.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def scan(batches):
        group, held = None, []
        for b in batches:
            people, offs = b.column("people").flatten(), np.r_[0, np.cumsum(b.column("people").value_lengths().to_numpy())]
            for i, (g, left, same) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "left", "same")), strict=True)):
                if held and g != group:
                    yield links(held)
                    held = []
                group = g
                held.append((left, same, people.slice(offs[i], offs[i + 1] - offs[i])))
        if held:
            yield links(held)

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(lean(scan), "a long, b long")


def similar_groups(docs: DataFrame, size: int = GRAM) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, class_id (smallest id with the same set), component_id."""
    prepare(docs.sparkSession)
    signed = materialize(describe(docs, gram_order(docs, size), size))
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "prefix", "parts")])
    # Numbers are fixed once the table is written.
    classes = materialize(classes.filter("low is not null").withColumn("rep", F.monotonically_increasing_id()))
    own = classes.select("rep", "low", "digest")

    filed = file_under(classes)
    shared = filed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = materialize(filed.join(shared, "key"))
    everyone = materialize(classes.select("rep", "n", "parts").join(members.select("rep").distinct(), "rep", "left_semi"))

    nearest = Window.partitionBy("rep").orderBy("pos")
    few = members.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= STAR_LISTS).drop("place")
    star, used = stars(few, everyone)
    star = materialize(star)
    release(*used)
    of_pairs = lambda pairs: own.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    sets = materialize(full_sets(docs, of_pairs(star), size))
    links = confirmed(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets)
    release(sets)
    # Texts of one id are one document.
    several = signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most")
    of_id = signed.select("doc_id", "digest").join(several, "doc_id").filter("digest is not null").select(F.col("least"), "digest").distinct()
    same = of_id.join(own.select(F.col("digest").alias("least"), F.col("rep").alias("a")), "least").join(own.select("digest", F.col("rep").alias("b")), "digest").filter("a <> b").select("a", "b")
    links = materialize(links.unionByName(same))

    found = components(links)
    labels = everyone.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "parts", F.coalesce("label", "rep").alias("label"))
    people = materialize(labels.join(homes_of(star, everyone), "rep"))
    more = materialize(across(members, people))
    if not more.isEmpty():
        met = people.join(more.select(F.explode(F.array("a", "b")).alias("home")).distinct(), "home", "left_semi")
        sets = materialize(full_sets(docs, own.join(met.select("rep"), "rep", "left_semi"), size))
        new = materialize(linked_across(more, met.join(sets, "rep")))
        found = components(links.unionByName(new))
        release(sets, new)
    release(members, everyone, star, people, more)
    labelled = found.withColumnRenamed("node", "rep").join(own, "rep")
    lowest = labelled.join(labelled.groupBy("label").agg(F.min("low").alias("lowest")), "label").select("rep", "lowest")
    classed = materialize(own.join(lowest, "rep", "left").select("digest", "low", F.coalesce("lowest", "low").alias("lowest")))
    release(classes, links)
    none = signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    some = signed.filter("n > 0").select("doc_id", "n", "digest").join(classed, "digest", "left")
    return none.unionByName(some.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("class_id"), F.coalesce("lowest", "doc_id").alias("component_id")))
