"""A corpus pipeline: quality classifier, quality rules, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; its result is written as Parquet and read again.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm.minhash_dedup import keep_first
from sigloom.llm.packing import pack
from sigloom.llm.quality_classifier import keep_good
from sigloom.llm.quality_rules import keep_by_rules
from sigloom.llm.queries import BYTE_BPE, trusted
from sigloom.llm.storage import Workspace, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the good labels' texts are the trusted ones."""
    return keep_by_rules(spark, docs, trusted(spark, docs, sf_dir))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more)."""
    return keep_first(spark, docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in windows of 2048 tokens; workers don't hold the encoder's memory after it."""
    return pack(docs, BYTE_BPE, keep_caches=False)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("minhash near-dedup", deduplicated),
    ("packing", packed),
]

#: SQL can't express the tokenizer of the last stage; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs, space = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.cut(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
