"""A corpus pipeline from the operators of foliant.llm: each stage's Parquet is the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last
return the columns of documents. Nulls, empty texts, repeated rows and empty tables have the
results that the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import byte_bpe, decontamination, ngram_join, quality, secret_scan
from foliant.llm.queries import MULTI_RANKS, vocabulary
from foliant.session import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, vocabulary(MULTI_RANKS))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", clean_of_benchmark),
    ("secret_scans", without_secrets),
    ("byte_bpe", encoded),
]
#: A fitted model decides in the stages, so SQL cannot give the rows; a test compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
