"""The incremental path: edit events to findings to history, with the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions.times import utc_wall_clock, with_event_time
from lintlake.operators.allow_list import apply_allow_list
from lintlake.operators.history import to_history
from lintlake.operators.projects import attribute_project
from lintlake.operators.reports import CODING_TOOLS
from lintlake.plans.scan import scan_all
from lintlake.sources.events import edited_files
from lintlake.sources.history_store import append_history


def stream_scan(files_stream: DataFrame, *keep: str) -> DataFrame:
    """Findings of a stream of (path, text, ...); the very plan of the batch scan, stateless."""
    return scan_all(files_stream, keep=keep)


def dedup_events(stream: DataFrame, delay: str, *key: str, time: str = "ts") -> DataFrame:
    """Each event once, however often it is delivered within ``delay``."""
    timed = with_event_time(stream, time, "event_time").withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("event_time")


def trailing_counts(stream: DataFrame, delay: str = "1 day", days: int = 7, time: str = "timestamp") -> DataFrame:
    """Findings per project and type in sliding windows of ``days``, one window per UTC day.

    Rows later than the watermark are dropped.  State is one counter per window, project and
    type, and tasks add up before the shuffle.
    """
    timed = with_event_time(stream, time, "event_time").withWatermark("event_time", delay)
    counts = timed.groupBy(F.window("event_time", f"{days} days", "1 day"), "project_hash", "violation_type")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        utc_wall_clock("window.start").alias("window_start"),
        utc_wall_clock("window.end").alias("window_end"),
        "project_hash",
        "violation_type",
        "n",
    )


def stream_upsert(
    stream: DataFrame,
    location: str,
    checkpoint: str,
    to_rows: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    tie_break: tuple[str, ...] = (),
) -> StreamingQuery:
    """Appends each micro-batch to the history log under the stream's and its own id; a replay is harmless.

    A stream keeps its id as long as it keeps its checkpoint.  Of rows with one key and time the
    one with the largest ``tie_break`` (columns of the rows, such as the order in which they were found) stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_history(to_rows(batch) if to_rows else batch, location, batch_id, writer, tie_break)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def scan_to_history(files_stream: DataFrame, location: str, checkpoint: str) -> StreamingQuery:
    """Edited files (path, text, ts, project_hash) to the history log."""

    def rows(batch: DataFrame) -> DataFrame:
        return to_history(scan_all(batch, keep=("project_hash", "ts")), F.col("ts"), "rule_order")

    return stream_upsert(files_stream, location, checkpoint, rows, tie_break=("rule_order",))


def event_chain(
    events: DataFrame,
    location: str,
    checkpoint: str,
    markers: Callable[[], DataFrame],
    config: Callable[[], DataFrame] | None = None,
    delay: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """From edit events to history: event -> project -> scan -> final round -> exceptions -> log.

    ``events`` is a stream of (event_id, json); a document names the tool, the file, the time and the contents of the
    file after each round of fixing (see ``sources.events.edited_files``).  Only coding tools count.  Rounds before
    the last are never scanned.  ``markers`` and ``config`` are asked once per micro-batch, so a batch meets the
    projects as they are by then; findings are joined to them by directory, texts are not shuffled.
    Findings that share key and time are settled by the order of the rules.  An event that comes
    twice gives the same rows again, which the log holds once; with ``delay`` it is not even
    scanned again within that time, at the price of a shuffle of the documents.
    """
    parsed = edited_files(events).filter(F.col("tool_name").isin(CODING_TOOLS))
    once = dedup_events(parsed, delay, "event_id") if delay else parsed

    def rows(batch: DataFrame) -> DataFrame:
        found = scan_all(batch.select("path", F.element_at("rounds", -1).alias("text"), "ts"), keep=("ts",))
        owned = attribute_project(found, markers()).select(*found.columns, "project_hash")
        kept = apply_allow_list(owned, config()) if config else owned
        return to_history(kept, F.col("ts"), "rule_order")

    return stream_upsert(once, location, checkpoint, rows, available_now, ("rule_order",))
