"""A training-data pipeline of five operators, from raw documents to packed sequences.

Each stage works on everything its predecessor kept, returns a DataFrame that is
written as Parquet and read again, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orderpulse.llm import jaccard_join, packing, secret_scan, substring_dedup, toxicity
from orderpulse.llm.common import ship, stage, table
from orderpulse.llm.queries import toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not reject."""
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8)."""
    ship(spark)
    return jaccard_join.dedup(docs, words=5, num=8, den=10)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that occur earlier."""
    ship(spark)
    return substring_dedup.dedup(docs, min_words=50)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets replaced by a mark."""
    ship(spark)
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither a trained classifier nor the packing; tests/llm compares
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
