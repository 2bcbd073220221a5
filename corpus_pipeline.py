"""The corpus pipeline: each stage works on the documents that the one before kept.

Language ID drops texts without a language, near-dedup all but one document of each class, decontamination the
documents that hold a test item; the secret scan masks what it finds, and mixing takes copies of what is left.
Every stage but the last returns the columns of ``documents``; the last adds ``copies``, of one or more
(``_copies`` if there is such a column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetable.llm import decontaminate, language, mixing, neardup, secrets
from kinetable.llm.common import fresh_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]
#: Trained and sketched stages have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
