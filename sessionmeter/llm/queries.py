"""The queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionmeter.llm import (
    decontaminate, license_scan, line_rules, ngram_join, packing, periodic_runs, pii_crf, quality_fm, simhash, spelling, suffix_lm,
    toxicity, warc,
)
from sessionmeter.llm.base import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive(table(spark, sf_dir, "pages"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scores(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.document_licences(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.found_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.spans(table(spark, sf_dir, "documents"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_quality_fm": op3_quality_fm,
    "op4_packing": op4_packing,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_pii_crf": op9_pii_crf,
    "op10_line_rules": op10_line_rules,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling": op13_spelling,
}
