"""The corpus pipeline: stages that each work on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.decontaminate import decontaminate
from lexweave.llm.mixing import mix_sources
from lexweave.llm.near_dup import deduplicate
from lexweave.llm.sstable import token_shards
from lexweave.llm.toxicity import without_toxic
from lexweave.llm.work import delete, new_path


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicate(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights; a document drawn twice is there twice."""
    mixed = mix_sources(docs)
    return mixed.drop(mixed.columns[-1])  # the copy's number


def stage_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, in sorted-string-table shards."""
    return token_shards(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
    ("token_shards", stage_token_shards),
]

#: SQL expresses neither the kernels' words nor the shards: tests hold the stages against their operators, and each operator
#: against a brute-force version, SQL or a round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet in the shared folder, read again by the next, and
    deleted once that one's is written (the last one's input stays: its rows are yet to be computed from it)."""
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
        docs = out
    return docs
