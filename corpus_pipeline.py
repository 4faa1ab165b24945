"""A training-data pipeline over ``documents``: each stage calls one operator of ``corpuslens.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import jaccard_join, packing, pii, quality, suffix_dedup
from corpuslens.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; the thresholds come from ``labels``."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard_join.keep_one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once."""
    return suffix_dedup.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data redacted."""
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of all documents lie in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
    ("personal data", personal_data), ("packing", sequences),
]
ORACLE_SQL = None  # forests, tries, suffix arrays, trees and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
