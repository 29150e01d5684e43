"""Corpus pipeline: language, near-duplicates, secrets, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import checkpointed
from tidemark.llm.language import accepted, fit_languages
from tidemark.llm.mixing import mixed
from tidemark.llm.secret_scan import redacted
from tidemark.llm.simhash import deduplicated
from tidemark.llm.tokens import encoded

VOCABULARY = "word_bpe_49k.json"
# The stages need models and encoders that SQL does not have.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that is told with probability 1/2 or more."""
    return accepted(docs, fit_languages(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies (five words, Jaccard 0.8).

    Candidates are SimHash fingerprints within two bits, by covering masks, and shared bands of minima.
    """
    return deduplicated(docs, width=5, similarity=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the values of found secrets; all documents stay."""
    return redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target weight asks for."""
    return mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every emitted document."""
    return encoded(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
