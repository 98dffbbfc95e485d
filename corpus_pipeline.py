"""Training-data pipeline: quality, exact copies, near copies, benchmark passages, token ids.

``STAGES`` lists (name, function).  Each function takes (spark, docs, sf_dir), works on all rows
that its predecessor kept, and returns a DataFrame; all but the last keep the columns of
documents, whatever else these hold.  ``run`` stores every stage's result as a Parquet table
in the shared checkpoint folder and reads it back, so a lost executor costs one stage at most.

Defined results: a null text counts as empty; rows with a null id are judged by their text
and never dropped as near copies; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultline.llm import bpe, decontam, exact_dedup, neardup, quality
from faultline.session import materialize

#: Near copies share 80 % of their word shingles; 18 equal coordinates miss a pair of exactly 80 % with a chance of 2e-7.
NEAR_PERCENT, NEAR_MATCHES = 80, 18


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, learned from ``labels``, rejects."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document with the smallest id."""
    return neardup.drop_near_copies(docs, percent=NEAR_PERCENT, matches=NEAR_MATCHES)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: The classifier is learned, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
