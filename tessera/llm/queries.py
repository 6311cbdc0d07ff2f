"""The opN_ queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import cut, table

#: (host, path, verdict) of the registered URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: What both turns of conversation -1 say.
ODD_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_knn import held_out, knn_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out())
    return knn_quality(docs, labels).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op3_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import repetition_quality

    return repetition_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("ids")


def op5_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simple8b import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_fingerprint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint_log import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op7_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate, digest

    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_tagpath_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tagpath import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_url_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_bloom import url_filter

    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op10_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dual_tree import lloyd

    return lloyd(table(spark, sf_dir, "embeddings"))


def op12_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, format_chat, read_chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)], turns.schema)
    return digest(read_chat(cut(format_chat(turns.unionByName(odd)), "chat")))


def op13_annular_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annular_pq import quantise

    return quantise(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests hold the others against brute force, round trips or held-out labels."""
    from . import chat_format, oracles

    return {
        "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op3_repetition_quality": oracles.repetition(),
        "op6_fingerprint_log": oracles.SUBSTRINGS,
        "op7_winnow_decontamination": oracles.DECONTAMINATION,
        "op9_url_bloom_filter": oracles.url_rules(URL_RULES),
        "op10_minhash_join": oracles.NEAR_DUPLICATES,
        "op11_dual_tree_lloyd": oracles.lloyd(),
        "op12_relational_chat": oracles.chat(chat_format.MARKS, chat_format.CONTROL),
        "op13_annular_pq": oracles.quantise(),
    }
