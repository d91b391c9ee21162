"""Fix/scan rounds of a file: where they stop and what the last one found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.sources.config import DEFAULT_MAX_ITERATIONS


def _file_key(rows: DataFrame) -> list[str]:
    return [c for c in ("project_hash", "path") if c in rows.columns]


def fix_convergence(rounds: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """(path, stop_round, errors_left, outcome) from (path, round, n_errors[, project_hash]).

    With project_hash a run is that of a path within its project, and the result names both.

    A run stops at the first round without errors (clean), with no fewer errors than the
    round before (stalled) or at the allowed number of rounds (exhausted); a run that shows
    none of these is still open.  Counts are added up per round before the window, so the
    window sees one row per round of a file.
    """
    by = _file_key(rounds)
    per_round = rounds.groupBy(*by, "round").agg(F.sum("n_errors").alias("n_errors"))
    if config is None:
        limited = per_round.withColumn("max_iterations", F.lit(DEFAULT_MAX_ITERATIONS))
    else:
        limits = config.select("project_hash", "max_iterations")
        limited = salted_join(per_round, limits, ["project_hash"], "left").withColumn(
            "max_iterations", F.coalesce("max_iterations", F.lit(DEFAULT_MAX_ITERATIONS))
        )
    in_time = W.partitionBy(*by).orderBy("round")
    before = F.lag("n_errors").over(in_time)
    outcome = (
        F.when(F.col("n_errors") == 0, "clean")
        .when(F.col("n_errors") >= before, "stalled")
        .when(F.col("round") >= F.col("max_iterations"), "exhausted")
    )
    seen = limited.filter(F.col("round") <= F.col("max_iterations")).withColumn("outcome", outcome)
    # The first round that stops; without one, the last round seen.
    order = F.when(F.col("outcome").isNotNull(), F.col("round")).otherwise(F.lit(1 << 30) - F.col("round"))
    first = F.min_by(F.struct("round", "n_errors", "outcome"), order)
    return (
        seen.groupBy(*by)
        .agg(first.alias("stop"))
        .select(
            *by,
            F.col("stop.round").alias("stop_round"),
            F.col("stop.n_errors").alias("errors_left"),
            F.coalesce("stop.outcome", F.lit("open")).alias("outcome"),
        )
    )


def final_round(violations: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """Only the findings of each file's last round; with project_hash, of each path in its project.

    ``rounds`` (path[, project_hash], round) tells which rounds took place: a last round without a finding leaves
    none of its file.  Without it, the last round with a finding counts.

    The last rounds, one row a file, come from an aggregation that combines before the shuffle
    and reads three columns.  The join back is a plain one: adaptive execution splits the
    partition of a file with very many findings, so they are not collected anywhere.
    """
    by = _file_key(violations)
    last = (violations if rounds is None else rounds).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("round").alias("_round"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return violations.join(last, [*same, F.col("round") == F.col("_round")], "left_semi")
