"""A training-data pipeline: quality, exact dedup, near dedup, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last keep the columns of documents. Null and empty texts, rows that repeat a doc_id or a whole
row, empty tables and further columns have the results that the operator of a stage defines for them.
"""

from __future__ import annotations

from ledgerweave.llm.common import written
from ledgerweave.llm.exact_dedup import drop_exact_duplicates
from ledgerweave.llm.near_dedup import drop_near_duplicates
from ledgerweave.llm.packing import pack
from ledgerweave.llm.private_data import redact
from ledgerweave.llm.quality import drop_low_quality
from pyspark.sql import DataFrame, SparkSession


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts 0 go; see drop_low_quality for the defined cases."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays; null texts are empty ones; see drop_exact_duplicates."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates from 0.80 stays; texts without words always stay; see drop_near_duplicates."""
    return drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; null texts stay null; see redact."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequences; null and empty texts are a separator alone; see pack."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", packing),
]

#: SQL can't express the trained classifier, MinHash, the span classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
