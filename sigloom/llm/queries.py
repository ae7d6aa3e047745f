"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.byte_bpe import round_trip
from sigloom.llm.embedding_dedup import embedding_dedup
from sigloom.llm.language_id import language_id
from sigloom.llm.license_scan import license_scan, tree_path
from sigloom.llm.license_scan import oracle as license_sql
from sigloom.llm.minhash_dedup import minhash_dedup
from sigloom.llm.packing import pack
from sigloom.llm.quality_classifier import quality_classifier
from sigloom.llm.quality_rules import oracle as quality_rules_sql
from sigloom.llm.quality_rules import counts_by_id, quality_rules
from sigloom.llm.storage import table
from sigloom.llm.token_counts import token_counts
from sigloom.llm.token_records import token_records

#: Where the vocabularies are; a parameter of every operator.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def trusted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Bucket counts of all texts that are labelled good."""
    return counts_by_id(spark, docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules(spark, docs, trusted(spark, docs, sf_dir))
    return out.drop("n_grams", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_records(spark, table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark, table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree; a document that states a licence stands for a licence file of its directory."""
    files = table(spark, sf_dir, "documents").select("doc_id", tree_path().alias("path"), "text")
    return license_scan(spark, files, stated_counts=True, keep=("doc_id",))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_records": op4_token_records,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules_sql(),
    "op8_license_scan": license_sql(),
}
