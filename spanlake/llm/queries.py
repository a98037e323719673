"""The numbered queries over the driver tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import ORACLE
from .tables import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    out = score(docs, train(docs, table(spark, sf_dir, "labels").filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import tokenize

    out = tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    out = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


#: (verdict, host, path); fixed values of the query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    held_out = remainder("doc_id", 4) == 2
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score

    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import proof_text, verify

    out = verify(spark, table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("segments")), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import similar_groups

    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


__all__ = ["ORACLE", "QUERIES"]
QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_language": op4_language,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_minhash": op8_minhash,
    "op9_topk": op9_topk,
    "op10_katz": op10_katz,
    "op11_lexical": op11_lexical,
    "op12_manifest": op12_manifest,
    "op13_ngram_join": op13_ngram_join,
}
