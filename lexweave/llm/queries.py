"""Queries of this subpackage's operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_count, decontaminate, kneser_ney, mixing, near_dup, pitman_yor, rules, sstable, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(_table(spark, sf_dir, "documents"))


def op6_contaminated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op9_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_model_scores(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_token_shards": op4_token_shards,
    "op5_token_counts": op5_token_counts,
    "op6_contaminated_spans": op6_contaminated_spans,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_model_scores": op9_language_model_scores,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.SQL,
    "op8_quality_rules": rules.quality_rules_sql(),
    "op10_mix_sources": mixing.mix_sources_sql(),
}
