"""The history of findings: last-write-wins rows, look-backs, top lists, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.times import wall_clock
from lintlake.schemas import HISTORY_COLUMNS, HISTORY_KEY


def _days_before(as_of: datetime, days: int) -> Column:
    return wall_clock(as_of) - F.make_dt_interval(F.lit(days))


def to_history(violations: DataFrame, as_of: datetime | Column, *keep: str) -> DataFrame:
    """History rows of a scan; ``violations`` carries project_hash and the columns in ``keep``."""
    stamp = as_of if isinstance(as_of, Column) else wall_clock(as_of)
    return violations.select(
        "project_hash",
        stamp.cast("timestamp_ntz").alias("timestamp"),
        F.col("path").alias("file_path"),
        P.base_name(F.col("path")).alias("file_name"),
        "line_num",
        "violation_type",
        "message",
        "fix_suggestion",
        "severity",
        "function_name",
        "language",
        *keep,
    )


def latest_per_key(history: DataFrame, *tie_break: str) -> DataFrame:
    """The newest row per key.

    ``max_by`` combines before the shuffle, so a key with a third of all rows sends one row
    per map task.
    """
    rest = [c for c in history.columns if c not in HISTORY_KEY]
    # Rows that tie in all of these are told apart by what they hold, not by chance.
    newest = F.max_by(F.struct(*rest), F.struct("timestamp", *tie_break, F.struct(*[c for c in rest if c not in tie_break])))
    return history.groupBy(*HISTORY_KEY).agg(newest.alias("_row")).select(*HISTORY_KEY, "_row.*").select(history.columns)


def upsert(history: DataFrame, batch: DataFrame, *tie_break: str) -> DataFrame:
    """``batch`` over ``history``; on equal timestamps the batch wins, then the tie-break."""
    columns = [*HISTORY_COLUMNS, *tie_break]
    both = history.select(columns).withColumn("_batch", F.lit(0)).unionByName(
        batch.select(columns).withColumn("_batch", F.lit(1))
    )
    return latest_per_key(both, "_batch", *tie_break).drop("_batch")


def expire(history: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Without the rows strictly older than ``days`` before ``as_of``."""
    return history.filter(F.col("timestamp") >= _days_before(as_of, days))


def look_back(history: DataFrame, as_of: datetime, days: int = 7, project: str | None = None) -> DataFrame:
    """Rows strictly newer than ``days`` before ``as_of``; plain comparisons that reach the scan."""
    recent = history.filter(F.col("timestamp") > _days_before(as_of, days))
    return recent if project is None else recent.filter(F.col("project_hash") == project)


def recent_violations(history: DataFrame, as_of: datetime, days: int = 7, project: str | None = None) -> DataFrame:
    """Newest first, without a limit."""
    return look_back(history, as_of, days, project).orderBy(F.desc("timestamp"))


def recent_top(history: DataFrame, as_of: datetime, days: int = 7, n: int = 20, *tie_break: str) -> DataFrame:
    return look_back(history, as_of, days).orderBy(F.desc("timestamp"), *tie_break).limit(n)


def top_n(counts: DataFrame, by: list[str], count: str, name: str, n: int) -> DataFrame:
    """The ``n`` largest per group, ties by name; Spark cuts each task to ``n`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(count), F.asc(name)))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def _count_by_detail(recent: DataFrame) -> DataFrame:
    """One hash aggregation that both top lists build on.

    Counting per advice text first keeps the text maximum, which Spark can only compute by
    sorting, off the raw rows.
    """
    return recent.groupBy("project_hash", "file_name", "violation_type", "fix_suggestion").agg(
        F.count(F.lit(1)).alias("n")
    )


def _types(detail: DataFrame) -> DataFrame:
    return detail.groupBy("project_hash", "violation_type").agg(
        F.sum("n").alias("count"), F.max("fix_suggestion").alias("fix_suggestion")
    )


def _files(detail: DataFrame) -> DataFrame:
    per_type = detail.groupBy("project_hash", "file_name", "violation_type").agg(F.sum("n").alias("n"))
    return per_type.groupBy("project_hash", "file_name").agg(
        F.sum("n").alias("violation_count"), F.count(F.lit(1)).alias("unique_violations")
    )


def top_violations(
    history: DataFrame, as_of: datetime, days: int = 7, limit: int = 10, project: str | None = None
) -> DataFrame:
    """Most frequent types of every project at once: count and the largest advice text."""
    recent = look_back(history, as_of, days, project)
    detail = recent.groupBy("project_hash", "violation_type", "fix_suggestion").agg(F.count(F.lit(1)).alias("n"))
    return top_n(_types(detail), ["project_hash"], "count", "violation_type", limit)


def repeat_offenders(
    history: DataFrame, as_of: datetime, days: int = 7, limit: int = 10, project: str | None = None
) -> DataFrame:
    """Files with most findings per project; equal base names count together."""
    recent = look_back(history, as_of, days, project)
    per_type = recent.groupBy("project_hash", "file_name", "violation_type").agg(F.count(F.lit(1)).alias("n"))
    return top_n(_files(per_type), ["project_hash"], "violation_count", "file_name", limit)


def learning_summary(
    history: DataFrame, as_of: datetime, days: int = 7, n_issues: int = 5, n_files: int = 3, project: str | None = None
) -> DataFrame:
    """(project_hash, generated_at, top_issues, problem_files), one row per project.

    The history is read once: a count per project, file, type and advice is counted again for its
    type and for its file, and both lists are cut to their length before they are gathered.
    """
    detail = _count_by_detail(look_back(history, as_of, days, project))
    issue, file = F.lit("issue"), F.lit("file")
    entries = F.array(
        F.struct(issue.alias("list"), F.col("violation_type").alias("name"), F.col("fix_suggestion").alias("fix")),
        F.struct(file.alias("list"), F.col("file_name").alias("name"), F.lit(None).cast("string").alias("fix")),
    )
    counted = detail.select("project_hash", "n", F.inline(entries)).groupBy("project_hash", "list", "name")
    counts = counted.agg(F.sum("n").alias("count"), F.max("fix").alias("fix"))
    ranked = top_n(counts, ["project_hash", "list"], "count", "name", max(n_issues, n_files))
    kept = ranked.filter(F.col("rank") <= F.when(F.col("list") == issue, n_issues).otherwise(n_files))

    def listed(which: Column, *fields: Column) -> Column:
        entry = F.when(F.col("list") == which, F.struct("rank", F.struct(*fields).alias("entry")))
        return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entry"])

    return kept.groupBy("project_hash").agg(
        wall_clock(as_of).alias("generated_at"),
        listed(issue, F.col("name").alias("type"), F.col("count"), F.col("fix")).alias("top_issues"),
        listed(file, F.col("name").alias("file"), F.col("count").alias("violations")).alias("problem_files"),
    )


def total_violations(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("total"))


def _top_by(history: DataFrame, column: str, n: int) -> DataFrame:
    counts = history.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(n)


def top_types(history: DataFrame, n: int = 10) -> DataFrame:
    return _top_by(history, "violation_type", n)


def top_files(history: DataFrame, n: int = 10) -> DataFrame:
    return _top_by(history, "file_name", n)
