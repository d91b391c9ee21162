"""Wall-clock times and instants: history uses the former, watermarks need the latter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def with_event_time(df: DataFrame, time: str, event_time: str) -> DataFrame:
    """Adds ``event_time``: ``time`` as an instant; wall-clock values are read as UTC, whatever
    the time zone of the session."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return df.withColumn(event_time, F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{time}`)")))
    return df.withColumn(event_time, F.col(time))


def utc_wall_clock(instant: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), {_EPOCH})")


def wall_clock(moment: datetime) -> Column:
    """A literal that no session time zone can move."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
