"""Queries of this folder over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from occurra.llm import centroid_clusters as centroids
from occurra.llm import chat_format as chat
from occurra.llm import mixing, periodic_runs
from occurra.llm.common import table
from occurra.llm.decontamination import contaminated_regions
from occurra.llm.language_id import language_id
from occurra.llm.license_scan import license_scan
from occurra.llm.ngram_join import ngram_jaccard_join
from occurra.llm.pii import personal_data
from occurra.llm.quality_rules import quality_rules
from occurra.llm.secret_scan import secret_scan
from occurra.llm.substring_dedup import repeated_passages
from occurra.llm.toxicity import toxicity


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digests(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    runs = (
        op1_ngram_jaccard_join, op2_substring_dedup, op3_source_mixing, op4_language_id, op5_benchmark_decontamination,
        op6_chat_formatting, op7_license_scans, op8_secret_scans, op9_personal_data, op10_quality_rules,
        op11_toxicity, op12_centroid_clusters, op13_periodic_runs,
    )
    return {run.__name__: run for run in runs}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_source_mixing": mixing.ORACLE_SQL,
        "op6_chat_formatting": chat.ORACLE_SQL,
        "op12_centroid_clusters": centroids.ORACLE_SQL,
        "op13_periodic_runs": periodic_runs.ORACLE_SQL,
    }
