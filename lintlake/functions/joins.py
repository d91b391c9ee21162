"""A join that survives hot keys on its large side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salt_of(*columns: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins on ``on`` with each key of the large side spread over ``salts`` tasks.

    ``small`` holds at most a few rows per key.  If Spark's estimate of it is below the broadcast
    threshold, this is a plain join.  Above that it is repeated per salt and both sides are shuffled, evenly
    although one key may own a third of ``large``; the repeated side is never broadcast, whose size the
    estimate does not know.
    """
    if _estimate(small) <= small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return large.join(small, on, how)
    spread = large.withColumn("_spread", salt_of(*[c for c in large.columns if _hashable(large, c)], salts=salts))
    repeated = small.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated.hint("merge"), [*on, "_spread"], how).drop("_spread")


def _estimate(df: DataFrame) -> int:
    """Spark's own estimate of a table's size in bytes, as its planner sees it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hashable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()
