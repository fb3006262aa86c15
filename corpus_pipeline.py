"""Raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmeter.llm import decontaminate, ngram_join, packing, pii_crf, quality_fm
from sessionmeter.llm.base import table
from sessionmeter.session import work_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_fm.score_column(docs, machine) >= 0.5)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return ngram_join.one_of_each(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return docs.withColumn("text", pii_crf.masked_column(docs, pii_crf.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near copies", no_copies),
    ("decontaminate", no_leaks),
    ("personal data", no_personal_data),
    ("packing", packed),
]

# sampling, training and packing can't be stated in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
