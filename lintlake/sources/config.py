"""Project configuration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults where a project sets nothing usable.
DEFAULT_MAX_ITERATIONS = 3
DEFAULT_TIMEOUT = 30

CONFIG_JSON = (
    "auto_fix struct<max_iterations:int, timeout:int>, mock_detection struct<allowed_patterns:array<string>>"
)


def project_config(raw: DataFrame) -> DataFrame:
    """(project_hash, allowed_patterns, max_iterations, timeout) with defaults filled in.

    ``raw`` has project_hash and either ``json``, the configuration as a JSON document, or
    the columns themselves.  Only positive whole numbers replace a default; a document that
    cannot be read counts as empty.
    """
    if "json" in raw.columns:
        raw = raw.withColumn("_c", F.from_json("json", CONFIG_JSON)).select(
            "project_hash",
            F.col("_c.mock_detection.allowed_patterns").alias("allowed_patterns"),
            F.col("_c.auto_fix.max_iterations").alias("max_iterations"),
            F.col("_c.auto_fix.timeout").alias("timeout"),
        )

    def positive(name: str, default: int):
        if name not in raw.columns:
            return F.lit(default).alias(name)
        return F.coalesce(F.when(F.col(name) > 0, F.col(name)), F.lit(default)).alias(name)

    return raw.select(
        "project_hash",
        F.coalesce("allowed_patterns", F.array().cast("array<string>")).alias("allowed_patterns"),
        positive("max_iterations", DEFAULT_MAX_ITERATIONS),
        positive("timeout", DEFAULT_TIMEOUT),
    )
