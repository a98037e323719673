"""A corpus pipeline of five stages: language, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes the documents that the one before kept, as a table, and all but the last return them with the
columns of ``documents``; ``run`` writes each stage's rows to the shared folder, reads them again and deletes them once
the next stage's are written.

Ids may repeat and be null: stages number the rows of their input, and each row gets its own decision.  Null and empty
texts go in the first stage, as do texts without a letter.  Texts are never cut short: what a very long one takes is said in
each operator.  Other columns of ``docs`` are dropped, so their names may clash; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.tables import materialize, numbered, release, remainder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter.  ``lang`` becomes the predicted one."""
    from spanlake.llm.langid import UNKNOWN, identify

    found = identify(docs.select(*COLUMNS), remainder("doc_id", 4) != 2)
    return found.filter(F.col("lang_pred") != UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows of one id that belong to one group stay together."""
    from spanlake.llm.neardup import near_duplicates as groups

    rows = numbered(docs, *COLUMNS)
    return rows.join(groups(rows, row="row").filter("kept").select("row"), "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that occur earlier.  A character that loses a byte goes; so does a text that loses all."""
    from spanlake.llm.repeats import remove_repeats

    def as_text(batches):
        for b in batches:
            rest = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(rest, pa.string())], ["row", "rest"])

    rows = numbered(docs, *COLUMNS)
    cut = remove_repeats(rows, row="row").filter("n_removed > 0").select("row", "kept").mapInArrow(as_text, "row long, rest string")
    text = F.coalesce("rest", "text")
    return rows.join(cut, "row", "left").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")).filter("text <> ''")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    from spanlake.llm.decontaminate import decontaminate

    rows = numbered(docs, *COLUMNS)
    hit = decontaminate(spark, rows, table(spark, sf_dir, "benchmark"), row="row").filter("contaminated").select("row")
    return rows.join(hit, "row", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of each document's ids and decoded bytes."""
    import public_tokenizers
    from spanlake.llm.bpe import tokenize

    out = tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]
#: Naive Bayes over hashed n-grams and byte-pair encoding have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
