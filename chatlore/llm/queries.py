"""Registered queries of the training-data operators (production parameters, whole tables) and
the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlore.llm import (align, best_fit, byte_bpe, cutting_stock, decontaminate, language_id, line_dedup, manifest, ngram_join,
                          pii, quality_knn, quality_rules, substring_dedup)
from chatlore.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_documents(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting_stock.pack_documents(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, and which."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("ref")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.digest(best_fit.pack_matrices(table(spark, sf_dir, "documents")))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_knn": op3_quality_knn,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_best_fit": op10_best_fit,
    "op11_align": op11_align,
    "op12_manifest": op12_manifest,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op12_manifest": manifest.ORACLE,
}
