"""A Merkle manifest of a table, and inclusion proofs from it by descent of a content-addressed DAG.

A row's leaf is the digest of its fields.  The leaves of a group ascend by a column, and while several nodes remain,
every 16 consecutive ones become their digest; what remains is the group's subroot, and the subroots, in order of their
groups, give the root in the same way.  What is stored is one record per inner node: digest -> digests of its children.

A leaf is asked for by its path, the base-16 digits of its group's place and of its own place within the group.  All
requests begin at the root and go down together: a node that many of them pass is opened once (a join on its digest),
its unselected children are kept as the segment of the proof at that level, and the segments are reversed at the end.
Only the last step makes a row of each leaf, so upper segments are moved once per 16 leaves.

Places come from a global sort and the counts of its partitions: no window runs over a group, however large it is.
All is DataFrame work; digests are 32 bytes in tables and hexadecimal text where they are hashed.

Nulls are leaves' fields of their own (``-``); null groups come first, null order values come first in their group.
Rows that are equal in group and order ascend by leaf; equal rows have leaves of their own.  Texts are hashed whole,
whatever their length.  An empty table has no root and gives no rows.  Other columns are ignored, so their names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialize, release

FANOUT, DIGEST = 16, 32
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """``leaves``: carried (struct), leaf, path.  ``store``: digest, children (concatenated).  ``root``: hexadecimal, None of nothing."""

    leaves: DataFrame
    store: DataFrame
    root: str | None
    group_digits: int
    depth: int


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf_digest(*fields: Column) -> Column:
    """The digest (binary) of a row's fields: each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digits(n: Column) -> Column:
    """How often a run of ``n`` nodes is gathered until one remains."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def _path(place: Column, digits: Column) -> Column:
    return F.when(digits > 0, F.lpad(F.hex(place), digits, F.lit("0"))).otherwise("")


def placed(rows: DataFrame, group: str | None, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their ``place`` (from 0) within ``group``, in ``order``; and the groups with their sizes ``n``.

    A sort over all rows, then the counts of (partition, group): each group's rows are a run of places of that sort.
    """
    keys = [group] if group else []
    there = materialize(rows.orderBy(*keys, *order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = materialize(there.groupBy("part", *keys).agg(F.count("*").alias("n"), F.min("at").alias("first")))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select(F.col("part").alias("run_part"), *[F.col(k).alias("run_group") for k in keys], "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    on = F.col("part") == F.col("run_part")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("run_group"))
    out = there.join(base, on).withColumn("place", F.col("base") + F.col("at") - F.col("first"))
    return out.drop("run_part", "run_group", "first", "base", "at", "part"), runs.groupBy(*keys).agg(F.sum("n").alias("n"))


def _raised(nodes: DataFrame) -> DataFrame:
    """One level up: (grp, n, place, children, digest) of ``nodes(grp, n, place, digest)``, for groups of several nodes."""
    run = F.sort_array(F.collect_list(F.struct("place", "digest")))  # 16 at most
    up = nodes.filter("n > 1").groupBy("grp", "n", F.shiftright("place", 4).alias("up")).agg(F.unhex(F.array_join(F.transform(run, lambda x: F.hex(x["digest"])), "")).alias("children"))
    return up.select("grp", F.shiftright(F.col("n") + FANOUT - 1, 4).alias("n"), F.col("up").alias("place"), "children", F.unhex(F.sha2(_text(F.col("children")), 256)).alias("digest"))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The tables of all levels above ``nodes``, of groups of at most ``most`` nodes."""
    out: list[DataFrame] = []
    while most > 1:
        out.append(materialize(_raised(out[-1] if out else nodes)))
        most = -(-most // FANOUT)
    return out


def build(rows: DataFrame, fields: list[str], group: str, order: str, **carried: Column) -> Manifest:
    """The manifest of ``rows``.  ``carried`` columns go with each leaf; they are computed in the scan that hashes it."""
    kept = F.struct(*[c.alias(name) for name, c in carried.items()])
    leaves = materialize(rows.select(F.col(group).alias("of"), F.col(order).alias("by"), leaf_digest(*map(F.col, fields)).alias("leaf"), kept.alias("carried")))
    ranked, groups = placed(leaves, "of", "by", "leaf")
    groups, _ = placed(groups, None, "of")
    groups = materialize(groups.withColumnRenamed("place", "grp"))
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    if not size.groups:
        return Manifest(leaves.select("carried", "leaf", F.lit("").alias("path")), leaves.select(F.col("leaf").alias("digest"), F.col("leaf").alias("children")), None, 0, 0)

    digits = len(f"{size.groups - 1:x}") if size.groups > 1 else 0
    of = groups.select(F.col("of").alias("group_of"), "n", "grp")
    ranked = materialize(ranked.join(of, F.col("of").eqNullSafe(F.col("group_of"))).select("carried", "leaf", "grp", "n", "place"))
    nodes = ranked.select("grp", "n", "place", F.col("leaf").alias("digest"))
    levels = _levels(nodes, size.most)
    subroots = nodes.filter("n = 1").select("grp", "digest")
    for level in levels:
        subroots = subroots.union(level.filter("n = 1").select("grp", "digest"))
    tops = materialize(subroots.select(F.lit(0).cast("long").alias("grp"), F.lit(size.groups).alias("n"), F.col("grp").alias("place"), "digest"))
    upper = _levels(tops, size.groups)
    root = (upper[-1] if upper else tops).select(_text(F.col("digest")).alias("root")).first().root

    store = leaves.limit(0).select(F.col("leaf").alias("digest"), F.col("leaf").alias("children"))
    for level in [*levels, *upper]:
        store = store.union(level.select("digest", "children"))
    store = materialize(store.dropDuplicates(["digest"]))
    path = F.concat(_path(F.col("grp"), F.lit(digits)), _path(F.col("place"), _digits(F.col("n"))))
    asked = materialize(ranked.select("carried", "leaf", path.alias("path")))
    release(leaves, groups, ranked, *levels, tops, *upper)
    return Manifest(asked, store, root, digits, digits + (len(f"{size.most - 1:x}") if size.most > 1 else 0))


def prove(spark: SparkSession, manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(carried, leaf, subroot, root, segments) of ``wanted`` leaves (all of them): segments are (left, right), from leaf to root."""
    leaves = manifest.leaves if wanted is None else wanted
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    top = F.unhex(F.lit(manifest.root))
    last = F.length("path") - 1
    digit = F.instr(F.lit("0123456789ABCDEF"), F.substr("path", F.length("path"), F.lit(1))) - 1
    asked = leaves.filter("path <> ''").groupBy(F.substr("path", F.lit(1), last).alias("prefix")).agg(F.collect_list(F.struct("carried", "leaf", digit.alias("digit"))).alias("leaves"))
    asked = materialize(asked)
    # The only leaf of a table is its own root.
    answers = leaves.filter("path = ''").select("carried", "leaf", F.col("leaf").alias("subroot"), none.alias("segments"))

    cut = lambda at: F.struct(F.substr("children", F.lit(1), DIGEST * at).alias("left"), F.substr("children", DIGEST * at + DIGEST + 1).alias("right"))
    frontier = spark.range(1).select(F.lit("").alias("path"), top.alias("digest"), F.when(F.lit(manifest.group_digits == 0), top).alias("subroot"), none.alias("segments"))
    for level in range(manifest.depth):
        opened = materialize(frontier.join(manifest.store, "digest").select("path", "children", "subroot", "segments"))
        here = asked.filter(F.length("prefix") == level).join(opened, F.col("prefix") == F.col("path"))
        here = here.select("children", "subroot", "segments", F.explode("leaves").alias("x"))
        answers = answers.union(here.select("x.carried", "x.leaf", F.coalesce("subroot", "x.leaf"), F.reverse(F.concat("segments", F.array(cut(F.col("x.digit")))))))
        if level + 1 < manifest.depth:
            # Only children that lead to a wanted leaf are taken down, so that segments aren't copied for others.
            way = asked.filter(F.length("prefix") > level).groupBy(F.substr("prefix", F.lit(1), F.lit(level)).alias("path"))
            way = way.agg(F.collect_set(F.conv(F.substr("prefix", F.lit(level + 1), F.lit(1)), 16, 10).cast("int")).alias("digits"))
            down = opened.join(way, "path").select("path", "children", "subroot", "segments", F.explode("digits").alias("i"))
            down = down.select(
                F.concat("path", F.hex("i")).alias("path"),
                F.substr("children", DIGEST * F.col("i") + 1, F.lit(DIGEST)).alias("digest"),
                "subroot",
                F.concat("segments", F.array(cut(F.col("i")))).alias("segments"),
            )
            if level + 1 == manifest.group_digits:
                down = down.withColumn("subroot", F.col("digest"))
            frontier = down
    return answers.select("carried", "leaf", "subroot", top.alias("root"), "segments")


def proof_text(segments: Column) -> Column:
    """The siblings from leaf to root, left to right, as hexadecimal text."""
    return F.array_join(F.transform(segments, lambda s: F.concat(_text(s["left"]), _text(s["right"]))), "")


def folded(leaf: Column, segments: Column) -> Column:
    """The root (hexadecimal) that a leaf and the siblings of a proof give."""
    return F.aggregate(segments, _text(leaf), lambda node, s: F.sha2(F.concat(_text(s["left"]), node, _text(s["right"])), 256))


def verify(spark: SparkSession, docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, segments, folded_root, verified, of ``docs(doc_id, source, lang, n_chars, text)``.

    Where ``tampered`` holds, the leaf that is folded is that of the row with A-Z of its text lower-cased.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = leaf_digest(*[F.col(f) for f in fields[:-1]], F.translate("text", CAPITALS, SMALL))
    manifest = build(docs, fields, "source", "doc_id", doc_id=F.col("doc_id"), claim=F.when(tampered, changed))
    out = prove(spark, manifest)
    out = out.select("carried.doc_id", *[_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "segments", folded(F.coalesce("carried.claim", "leaf"), F.col("segments")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
