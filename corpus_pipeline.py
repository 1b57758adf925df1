"""The corpus pipeline: quality rules, near-dedup, passage dedup, mixing, encoding.

Each stage takes what its predecessor kept and returns the columns of documents, the last one the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, numbered
from docloom.llm.mixing import mix
from docloom.llm.pieces import encode
from docloom.llm.quality_rules import quality_verdicts
from docloom.llm.simhash import near_duplicates
from docloom.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, row = numbered(docs, Scratch(spark, "rows"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = quality_verdicts(rows, labels, carry=(row,)).where("not kept").select(row)
    return rows.join(rejected, row, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    rows, row = numbered(docs, Scratch(spark, "rows"))
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return rows.join(others, row, "left_anti").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that stand in 200-byte strings found elsewhere; a null text becomes empty."""
    return remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' rates, in a global shuffle."""
    return mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    scratch = Scratch(spark, "pieces")
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return encode(rows, public_tokenizers.path("piece_bpe_32k.model"), scratch).withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: Several stages cannot be written in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = scratch.table(out, str(i))
    return out
