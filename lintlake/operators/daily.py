"""Look-backs kept up batch by batch: counts per day that add up, and take back what an upsert moves.

A count is the number of *current* rows (last write wins) of a day, project, file name, type and advice.
A batch changes it by what its keys hold afterwards less what they held before, so counts of any days are
sums of changes.  Whole days come from the counts; only the day on which a look-back starts is
read from the history itself.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.times import wall_clock
from lintlake.operators.history import _files, _types, latest_per_key, top_n
from lintlake.schemas import HISTORY_COLUMNS, HISTORY_KEY
from lintlake.sources.history_store import PARTITIONS, append_history, stored_log

DAILY = ["event_date", "project_hash", "file_name", "violation_type", "fix_suggestion"]
DAILY_SCHEMA = "event_date date, project_hash string, file_name string, violation_type string, fix_suggestion string, n bigint"


def daily_counts(history: DataFrame) -> DataFrame:
    """(event_date, project_hash, file_name, violation_type, fix_suggestion, n) of current rows."""
    return history.withColumn("event_date", F.to_date("timestamp")).groupBy(*DAILY).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(changes: DataFrame) -> DataFrame:
    """The sum of all changes; what is down to nothing is gone."""
    return changes.groupBy(*DAILY).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def daily_changes(log: DataFrame, batch: DataFrame, *order: str) -> DataFrame:
    """What ``batch`` changes in the daily counts of ``log``; both have the history columns and ``order``.

    Only rows of the log with a key of the batch take part; ``order`` decides between rows of
    one key and time, as it does where the log is read.
    """
    columns = [*HISTORY_COLUMNS, *order]
    touched = log.select(columns).join(batch.select(*HISTORY_KEY).distinct(), HISTORY_KEY, "left_semi")
    before = latest_per_key(touched, *order)
    after = latest_per_key(touched.unionByName(batch.select(columns)), *order)
    signed = daily_counts(after).unionByName(daily_counts(before).withColumn("n", -F.col("n")))
    return merge_counts(signed)


def record_batch(
    batch: DataFrame, history: str, counts: str, batch_id: int, writer: str, tie_break: tuple[str, ...] = ()
) -> None:
    """Appends a batch to the history log and its changes to the log of counts; a replay changes nothing.

    The changes are taken against the log without this very batch, so it does not matter
    whether an earlier attempt got as far as the history.  Batches are recorded one after the other.
    """
    spark = batch.sparkSession
    merged = latest_per_key(batch.select(*HISTORY_COLUMNS, *tie_break), *tie_break).select(HISTORY_COLUMNS)
    own = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
    marked = merged.withColumns({"batch_id": F.lit(batch_id).cast("long"), "writer": F.lit(writer)})
    changes = daily_changes(stored_log(spark, history).filter(~own), marked, "batch_id", "writer")
    placed = changes.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")})
    laid = placed.hint("rebalance", F.col("event_date"))
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(counts)
    append_history(merged, history, batch_id, writer)


def read_counts(spark: SparkSession, counts: str, newer_than: datetime | None = None) -> DataFrame:
    """The daily counts, optionally only of whole days after the day of a point in time."""
    log = spark.read.schema(f"{DAILY_SCHEMA}, writer string, batch_id bigint").parquet(counts)
    if newer_than is not None:
        log = log.filter(F.col("event_date") > F.lit(newer_than.date()))
    return merge_counts(log.select(*DAILY, "n"))


def look_back_counts(counts: DataFrame, first_day: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Counts of the rows strictly newer than ``days`` before ``as_of``.

    ``first_day`` has the current rows of the day on which the look-back starts, or more of the
    history; other days of it are left out.
    """
    start = as_of - timedelta(days=days)
    whole = counts.filter(F.col("event_date") > F.lit(start.date()))
    rest = first_day.filter((F.to_date("timestamp") == F.lit(start.date())) & (F.col("timestamp") > wall_clock(start)))
    return whole.unionByName(daily_counts(rest))


def top_violations_of(counts: DataFrame, limit: int = 10) -> DataFrame:
    """``top_violations`` from counts of a look-back."""
    return top_n(_types(counts), ["project_hash"], "count", "violation_type", limit)


def repeat_offenders_of(counts: DataFrame, limit: int = 10) -> DataFrame:
    """``repeat_offenders`` from counts of a look-back."""
    return top_n(_files(counts), ["project_hash"], "violation_count", "file_name", limit)
