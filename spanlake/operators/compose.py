"""Composing reports and samples from fields and texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import bound_batches
from ..sources.sinks import staged
from .chunk import paragraphs, token_windows
from .curate import bucket, chance
from .prefix import confirmed, frequency_order, prefixes


def within_budget(docs: DataFrame, budget: int, separator: str) -> DataFrame:
    """(doc_id, part, body): the whole text if its tokens fit, else its paragraphs."""
    rows = docs.withColumn("fits", T.token_count(F.col("text")) <= budget)
    whole = rows.filter("fits").select("doc_id", F.lit(0).alias("part"), F.col("text").alias("body"))
    return whole.unionByName(paragraphs(rows.filter("not fits").select("doc_id", "text"), separator).select("doc_id", F.col("par").alias("part"), "body"))


def window_samples(docs: DataFrame, answers: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, key, chunk, positive) of windows of docs(doc_id, text) that meet the answer of answers(doc_id, key, start, end).

    Keys without an answer (start -1) give one sample without a window.
    """
    w = token_windows(docs, size, overlap).withColumn("n", F.length("chunk_text"))
    head = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n]+[ \t\n]*"), F.lit(0)).alias("w"), F.length(F.regexp_extract("text", r"^[ \t\n]*", 0)).alias("lead"))
    w = w.join(head, "doc_id").withColumn("a", F.aggregate(F.slice("w", F.lit(1), F.col("first_token")), F.lit(0), lambda s, x: s + F.length(x)) + F.when(F.col("first_token") > 0, F.col("lead")).otherwise(0))
    met = w.join(answers.filter("start >= 0"), "doc_id").filter((F.col("start") < F.col("a") + F.col("n")) & (F.col("end") > F.col("a")))
    none = answers.filter("start < 0").select("doc_id", "key", F.lit(-1).alias("chunk"), F.lit(False).alias("positive"))
    return met.select("doc_id", "key", "chunk", F.lit(True).alias("positive")).unionByName(none)


def key_rounds(keys: DataFrame, key: str, start: float, growth: float, rounds: int, seed: int) -> DataFrame:
    """``round`` in which each key is first used: a share ``start`` in round 0, then ``growth`` of all in each, by chance of the key."""
    place = F.conv(F.substring(chance(seed, F.col(key)), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return keys.withColumn("round", F.least(F.lit(rounds), F.greatest(F.lit(0), F.ceil((place - start) / growth))).cast("int"))


def drop_frequent(records: DataFrame, thresholds: DataFrame, share: float, seed: int) -> DataFrame:
    """Records (id, title, key, n, has_alias) without ``share`` of each record's frequent keys; those without alias go first."""
    rows = records.join(thresholds, "title").withColumn("frequent", F.col("n") >= F.col("threshold"))
    by = Window.partitionBy("id", "frequent").orderBy(F.col("has_alias").cast("int"), chance(seed, F.col("id"), F.col("key")), "key", "title")
    rows = rows.withColumn("rn", F.row_number().over(by)).withColumn("k", F.count("*").over(Window.partitionBy("id", "frequent")))
    return rows.filter(~(F.col("frequent") & (F.col("rn") <= F.ceil(F.col("k") * share)))).drop("frequent", "rn", "k", "threshold")


def jitter(records: DataFrame, drop: float, least: int, seed: int) -> DataFrame:
    """Each key goes with chance ``drop``, but the ``least`` luckiest of a record stay."""
    by = Window.partitionBy("id").orderBy(F.desc("luck"), "key")
    rows = records.withColumn("luck", bucket(F.lit(f"{seed}:"), F.col("id"), F.lit(":"), F.col("key"))).withColumn("rn", F.row_number().over(by))
    return rows.filter((F.col("luck") >= int(drop * 10_000)) | (F.col("rn") <= least)).drop("luck", "rn")


def reports(records: DataFrame, structure: DataFrame, separators: list[str]) -> DataFrame:
    """(id, title, report): a title line and the fields in the structure's order, with separators in turn."""
    rows = records.groupBy("id", "title", "key").agg(F.min("ord").alias("own"), F.min_by("value", "ord").alias("value")).join(structure, ["title", "key"], "left")
    by = Window.partitionBy("id", "title").orderBy(F.coalesce("ord", F.lit(1 << 40) + F.col("own")), "key")
    rows = rows.withColumn("rn", F.row_number().over(by)).withColumn("line", F.concat("key", F.element_at(F.array(*map(F.lit, separators)), ((F.col("rn") - 1) % len(separators) + 1).cast("int")), "value"))
    listed = rows.groupBy("id", "title").agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("x"))
    return listed.select("id", "title", F.concat("title", F.lit("\n"), F.array_join(F.transform("x", lambda t: t["line"]), "\n")).alias("report"))


def wanted_keys(records: DataFrame, structure: DataFrame) -> DataFrame:
    """(id, keys): the title's keys first, then the record's own, once each."""
    own = records.groupBy("id", "title").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]).alias("own"))
    of = structure.groupBy("title").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]).alias("std"))
    return own.join(of, "title", "left").select("id", "title", F.array_distinct(F.concat(F.coalesce("std", F.expr("cast(array() as array<string>)")), "own")).alias("keys"))


#: Sets with one shingle that meet as a block; a shingle of more sets is dealt into sub-blocks, each pair of them a key.
MEETING_ROWS = 1000


def _shingles(words: int) -> Column:
    """The sorted distinct hashes of the text's shingles; null where there are no words."""

    def grams_of(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, words), " ")))
        return F.when(F.size(w) >= words, long).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))

    # As a lambda's variable the words are split once, not again for each shingle.
    grams = F.get(F.transform(F.array(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")), grams_of), F.lit(0))
    return F.array_sort(F.array_distinct(grams))


def _shingle_sets(docs: DataFrame, block: str, words: int) -> DataFrame:
    """(doc_id, block, g) of docs(doc_id, text, block); the block as a text that is never null, g null where there are no words."""
    of = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit(""))
    return docs.select("doc_id", of.alias("block"), _shingles(words).alias("g"))


def near_duplicate_members(docs: DataFrame, block: str, words: int = 5) -> DataFrame:
    """(doc_id, class_id) of each row of docs(doc_id, text, block): the smallest id of its block with the same shingle set.

    These are the ids that ``near_duplicate_pairs`` pairs.  A null block is a block; texts without words are alone.
    """
    rows = _shingle_sets(docs, block, words).select("doc_id", "block", F.md5(F.array_join(F.col("g").cast("array<string>"), " ")).alias("set"))
    classes = rows.filter("set is not null").groupBy("block", "set").agg(F.min("doc_id").alias("class_id"))
    return rows.join(classes, ["block", "set"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicate_pairs(docs: DataFrame, block: str, threshold: float = 0.75, words: int = 5, meeting_rows: int = MEETING_ROWS) -> DataFrame:
    """(a, b) of docs(doc_id, text, block) of one block whose word-shingle sets have a Jaccard index of ``threshold``.

    Only the rarest shingles of each set are joined: sets that alike share one of their size - ceil(threshold * size) + 1
    rarest, and what follows the shared ones in both holds the overlap.  Rare is told by counts in buckets, so that a set's
    rarest are known where it is read and no other shingle becomes a row.  Equal sets stand for each other: pairs are of
    the smallest ids with each set, and ``near_duplicate_members`` tells whom these stand for.  A null block is a block.
    """
    bound_batches(docs.sparkSession)
    sets = _shingle_sets(docs, block, words).filter("g is not null")
    own = prefixes(sets, frequency_order(sets), threshold).groupBy("block", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    filed = own.select("block", "doc_id", "n", F.posexplode("prefix").alias("pos", "h")).select(F.xxhash64("block", "h").alias("key"), "doc_id", (F.col("n") - F.col("pos")).alias("rest"), "n")
    filed = staged(filed.withColumn("df", F.count("*").over(Window.partitionBy("key"))).filter("df > 1"))  # others join nothing
    parts = F.ceil(F.col("df") / meeting_rows)
    part, each = F.pmod(F.xxhash64("doc_id"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    a = filed.select("key", part.alias("i"), each.alias("j"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    b = filed.select("key", each.alias("i"), part.alias("j"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    left = F.least("ra", "rb")
    fits = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")) & (left >= F.lit(threshold) * (F.col("na") + F.col("nb") - left))
    pairs = staged(a.join(b, ["key", "i", "j"]).filter((F.col("a") < F.col("b")) & fits).select("a", "b", "na", "nb").distinct())
    return confirmed(pairs, docs, _shingles(words), threshold)


def scored(inputs: DataFrame, column: str, score: Callable[[str], str], tries: int = 3) -> DataFrame:
    """``inputs`` with ``result`` and ``error`` of ``score(value)``; each distinct value is scored once, with retries."""

    def run(batches):
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                result, error = None, None
                for _ in range(tries):
                    try:
                        result, error = score(value), None
                        break
                    except Exception as e:  # a failing value is an answer too
                        error = f"{type(e).__name__}: {e}"
                out.append((value, result, error))
            yield pd.DataFrame(out, columns=["value", "result", "error"])

    answers = inputs.select(F.col(column).alias("value")).distinct().mapInPandas(run, "value string, result string, error string")
    return inputs.join(answers.withColumnRenamed("value", column), column, "left")


def unknown_tokens(docs: DataFrame, vocabulary: DataFrame, reach: int) -> DataFrame:
    """(doc_id, pos, token, around): tokens of docs(doc_id, text) that vocabulary(token) lacks, with ``reach`` tokens on either side."""
    rows = docs.select("doc_id", F.split("text", " ").alias("w"))
    flat = rows.select("doc_id", F.posexplode("w").alias("pos", "token")).join(vocabulary.select("token").distinct(), "token", "left_anti")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    return flat.join(rows, "doc_id").select("doc_id", "pos", "token", F.array_join(F.slice("w", first + 1, F.col("pos") + reach + 1 - first), " ").alias("around"))


def option_candidates(records: DataFrame, options: DataFrame) -> DataFrame:
    """(id, key, option, chosen): every option of options(key, option) for a record's field, and whether the value names it."""
    return records.join(options, "key").select("id", "key", "option", F.array_contains(F.split("value", "/"), F.col("option")).alias("chosen"))


def decided_aliases(evidence: DataFrame, known: DataFrame, decisions: DataFrame) -> DataFrame:
    """(title, canon, alias, source): evidence(title, alias, source) of unknown keys, each once; undecided ones are canonical."""
    new = evidence.join(known.select("title", F.col("key").alias("alias")), ["title", "alias"], "left_anti")
    return new.join(decisions, "alias", "left").select("title", F.coalesce("canon", "alias").alias("canon"), "alias", "source").distinct()
