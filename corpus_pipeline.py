"""From raw documents to a mixed training order: five stages, each written as Parquet and read again by the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where
docs is what the stage before kept, and all but the last return the columns of
``documents``. Null, empty, repeated and very long texts are taken as the
operators' docstrings say; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm import common, decontaminate, minhash_dedup, mixing, quality_rules, secret_ledger


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.accepted(docs, trusted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.deduplicated(docs, k=5, percent=80, bands=36, rows=5).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, re-parameterised ones included."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text; every document stays."""
    return secret_ledger.redacted(docs, common.fresh_path(spark, "ledger"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's turn in the mix of sources."""
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing_stage)]

#: SQL can't express the hashed n-gram model nor the schedule; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
