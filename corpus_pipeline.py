"""From raw documents to a training mix: the stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from lintlake.llm.frames import begin, end, run_folder, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """Before the stage begins, drops the tables and shuffles that the stage before it needed; its result is written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin(spark, docs)
        return stage(spark, docs, sf_dir)

    return run_stage


@tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go."""
    return language_id.keep_identified(docs)


@tidy
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes, n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    left = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


@tidy
def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with how many of their words it takes and in which shards."""
    return mixing.mix_rows(docs)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

# Stages with learned or random decisions have no SQL; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, f"{place}/{name}")
    end(spark)
    return docs
