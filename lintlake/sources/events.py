"""Edit events as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "tool_name string, tool_input struct<file_path:string, content:string, rounds:array<string>>, file_path string, ts timestamp_ntz"


def edit_events(df_json: DataFrame, column: str = "json", *keep: str) -> DataFrame:
    """(tool_name, path): the path in tool_input, else the one at the top; '' counts as absent.

    Unreadable events and events without a path give no row.
    """
    event = F.from_json(column, EVENT)
    path = F.coalesce(F.nullif(F.col("_e.tool_input.file_path"), F.lit("")), F.nullif(F.col("_e.file_path"), F.lit("")))
    parsed = df_json.withColumn("_e", event).select(
        *keep, F.coalesce("_e.tool_name", F.lit("")).alias("tool_name"), path.alias("path")
    )
    return parsed.filter(F.col("path").isNotNull())


def edited_files(df_json: DataFrame, column: str = "json") -> DataFrame:
    """(event_id, tool_name, path, ts, rounds): the contents of the file after each round of an event.

    ``rounds`` of the document, else its content as the only round; events with neither give no row.
    """
    event = F.from_json(column, EVENT)
    path = F.coalesce(F.nullif(F.col("_e.tool_input.file_path"), F.lit("")), F.nullif(F.col("_e.file_path"), F.lit("")))
    content = F.col("_e.tool_input.content")
    rounds = F.coalesce("_e.tool_input.rounds", F.when(content.isNotNull(), F.array(content)))
    parsed = df_json.withColumn("_e", event).select(
        "event_id", F.coalesce("_e.tool_name", F.lit("")).alias("tool_name"), path.alias("path"), F.col("_e.ts").alias("ts"), rounds.alias("rounds")
    )
    return parsed.filter(F.col("path").isNotNull() & (F.size("rounds") > 0))
