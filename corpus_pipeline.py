"""Corpus pipeline: quality rules, exact dedup, near-duplicate removal, mixing and packing, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm.common import sources_table, stage
from logtide.llm.exact_dedup import drop_exact_duplicates
from logtide.llm.mixing import apply_mix
from logtide.llm.ngram_join import drop_near_duplicates
from logtide.llm.packing import pack_documents
from logtide.llm.quality_rules import drop_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return drop_low_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents with similar sets of word 5-grams (Jaccard 0.8 or more)."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("packing", pack)]

#: Robust estimates, set similarity components and bin packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again by the next."""
    docs = sources_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
