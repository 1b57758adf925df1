"""The corpus operators' queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat, mixing, quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no", "shuffle_key", "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str, holdout_rows: str = quality_rules.FOLD) -> DataFrame:
    from docloom.llm.quality_rules import quality_verdicts

    out = quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), holdout_rows=holdout_rows)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*base, F.array_join("rule_failed", ",").alias("rules"))


def op2_quality_rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts with cutoffs from all labelled rows; op2_quality_rules keeps the fold that its SQL has."""
    return op2_quality_rules(spark, sf_dir, "true")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.bpe import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.jpeg import features, store

    return features(store(_table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.chat import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.byte_cnn import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.pieces import encoded_documents

    return encoded_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op2_quality_rules_all": op2_quality_rules_all,
    "op3_token_counts": op3_token_counts,
    "op4_token_files": op4_token_files,
    "op5_jpeg": op5_jpeg,
    "op6_simhash": op6_simhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat": op8_chat,
    "op9_byte_cnn": op9_byte_cnn,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_quality_rules": quality_rules.oracle_sql(),
    "op2_quality_rules_all": quality_rules.oracle_sql(fold=False),
    "op8_chat": chat.ORACLE_SQL,
}
