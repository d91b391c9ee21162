"""Decisions as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_decisions(decisions: DataFrame, location: str) -> None:
    """One JSON document a line: path, decision and reason."""
    decisions.select("path", "decision", "reason").write.mode("overwrite").json(location)


def decision_json(decisions: DataFrame) -> DataFrame:
    """(path, json): the decision document of each file."""
    return decisions.select("path", F.to_json(F.struct("decision", "reason")).alias("json"))
