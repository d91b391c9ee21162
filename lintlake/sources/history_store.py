"""The history table on shared storage: an append-only log, merged when it is read.

Rows are partitioned by event date, by who wrote them and by the id of the batch.

* Writing a batch never touches older data, and writing it again replaces exactly its own
  partitions, so a retried or replayed batch changes nothing.  Batch ids start at 0 for every
  stream, so the name of the writer keeps streams and callers apart.
* Reading keeps the newest row per key.  A look-back filters on time *first*: the newest row
  of a key inside the window is its newest row overall, so old partitions are not opened.
* ``compact`` rewrites the log with one row per key, without expired rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.times import wall_clock
from lintlake.operators.history import expire, latest_per_key
from lintlake.schemas import HISTORY, HISTORY_COLUMNS

COMPACTION = "compaction"
PARTITIONS = ["event_date", "writer", "batch_id"]


# Upper bound of one file of the log; larger writes are cut into several.
MAX_RECORDS_PER_FILE = 5_000_000


def _dated(rows: DataFrame, batch_id: int, writer: str, tasks_per_day: int) -> DataFrame:
    """Rows laid out for a partitioned write: neither one tiny file per day and task, nor all of
    a hot day in one task.

    With adaptive execution Spark splits and merges the days by size.  Streams may run without
    it; then a day is spread over ``tasks_per_day`` tasks.
    """
    dated = rows.withColumn("event_date", F.to_date("timestamp"))
    dated = dated.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("long")})
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        laid = dated.hint("rebalance", F.col("event_date"))
    else:
        laid = dated.repartition("event_date", F.pmod(F.xxhash64("project_hash", "file_path", "line_num"), F.lit(tasks_per_day)))
    return laid.sortWithinPartitions("event_date", "project_hash", "timestamp")


def append_history(
    batch: DataFrame, location: str, batch_id: int, writer: str, tie_break: tuple[str, ...] = (), tasks_per_day: int = 64
) -> None:
    """Writes one batch of one writer, its own duplicates merged.

    Of rows with one key and time the largest in ``tie_break`` (columns of the batch, such as
    the order in which they were found) stays, then the largest row.
    """
    if not writer:
        raise ValueError("name the writer: equal batch ids of two writers would replace each other")
    merged = latest_per_key(batch.select(*HISTORY_COLUMNS, *tie_break), *tie_break).select(HISTORY_COLUMNS)
    (
        _dated(merged, batch_id, writer, tasks_per_day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*PARTITIONS)
        .parquet(location)
    )


def stored_log(spark: SparkSession, location: str) -> DataFrame:
    """All rows ever written, with event_date, writer and batch_id; nothing if there is no log yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _stored_schema())
    return spark.read.schema(_stored_schema()).parquet(location)


def read_history(spark: SparkSession, location: str, newer_than: datetime | None = None) -> DataFrame:
    """Current rows, optionally only those strictly newer than a point in time."""
    log = spark.read.schema(_stored_schema()).parquet(location)
    if newer_than is not None:
        log = log.filter(
            (F.col("event_date") >= F.lit(newer_than.date())) & (F.col("timestamp") > wall_clock(newer_than))
        )
    return latest_per_key(log.select(*HISTORY_COLUMNS, "batch_id", "writer"), "batch_id", "writer").drop("batch_id", "writer")


def _stored_schema() -> str:
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields]
    return ", ".join([*fields, "event_date date", "writer string", "batch_id bigint"])


def compact(
    spark: SparkSession,
    location: str,
    target: str,
    as_of: datetime | None = None,
    days: int = 90,
    tasks_per_day: int = 64,
) -> None:
    """Writes the merged history to ``target``; with ``as_of``, without expired rows.

    Readers and writers go on with ``target``: later batches may be appended to it.
    """
    if target.rstrip("/") == location.rstrip("/"):
        raise ValueError("compact into another folder: writing over the log would delete what is read")
    newer = as_of - timedelta(days=days + 1) if as_of else None
    rows = read_history(spark, location, newer)
    if as_of:
        rows = expire(rows, as_of, days)
    (
        _dated(rows, -1, COMPACTION, tasks_per_day)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(*PARTITIONS)
        .parquet(target)
    )
