"""Corpus pipeline: the stages in order, each over all rows that its predecessor kept.

Every stage takes an empty table to an empty one, leaves nulls in any column as they are, and tells rows apart by doc_id and content, so that rows
without an id, or that share one, are rows of their own. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from paperloom.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: texts without letters (null and empty ones too) and those that fit none; ties go to the language first in order. Without any label all stay."""
    return language_id.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one of most code points, then of the smallest id (null last); null texts count as empty, repeated rows as copies."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: the one of the smallest id (null last), then of the least hash of its text. Texts without words are similar to nothing and stay."""
    return jaccard_join.distinct_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for; a null source is one of its own, and texts without tokens go with their block."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text; null counts as the empty text, a row for each row."""
    return bpe.digest(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("source_mixing", mixed_sources),
    ("bpe", tokens),
]
#: Posteriors, components of links and byte-pair merges are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
