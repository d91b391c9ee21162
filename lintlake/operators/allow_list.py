"""Exceptions: allowed mock targets per project and allow comments in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.functions.text import glob_to_regex

# Both documented spellings of the comment.
ALLOW_COMMENT = r"#.*\b(?:allow-mock|disable-mock)\b"


def apply_allow_list(violations: DataFrame, config: DataFrame) -> DataFrame:
    """Drops mock findings whose target matches a glob of their project.

    An equi-join on the project, read once: rows that are no mock findings get a key of their
    own that matches nothing, so they stay spread evenly if the join has to shuffle.  Globs
    become regexes once per project, not once per finding.
    """
    patterns = config.select(
        F.concat(F.lit("p"), "project_hash").alias("_key"),
        F.transform("allowed_patterns", glob_to_regex).alias("_allowed"),
    ).filter(F.size("_allowed") > 0)
    is_mock = F.col("violation_type") == "mock_violation"
    target = F.element_at("language_context", "mock_target")
    keyed = violations.withColumn(
        "_key",
        F.when(is_mock, F.concat(F.lit("p"), "project_hash")).otherwise(
            F.concat(F.lit("-"), F.xxhash64("path", "rule_order").cast("string"))
        ),
    )
    joined = salted_join(keyed, patterns, ["_key"], how="left")
    allowed = F.exists("_allowed", lambda regex: F.rlike(target, regex))
    return joined.filter(~F.coalesce(allowed, F.lit(False))).select(violations.columns)


# A glob is literal up to the first of these.
_LITERAL_PREFIX = r"^[^*?\[]*"


def apply_allow_index(violations: DataFrame, config: DataFrame) -> DataFrame:
    """The same answer as :func:`apply_allow_list`, for projects with thousands of globs.

    Every glob is filed under its project and the literal text it starts with.  The distinct targets of a
    project look themselves up under all their beginnings, so only globs that share one are tried,
    once per target and not once per finding.  ``violations`` are read twice; hand in a stored
    table, or a scan that is worth it.
    """
    globs = config.select("project_hash", F.explode(F.array_distinct("allowed_patterns")).alias("_glob"))
    filed = globs.select("project_hash", F.regexp_extract("_glob", _LITERAL_PREFIX, 0).alias("_prefix"), glob_to_regex(F.col("_glob")).alias("_regex"))
    target = F.when(F.col("violation_type") == "mock_violation", F.element_at("language_context", "mock_target"))
    targets = violations.select("project_hash", target.alias("_target")).filter(F.col("_target").isNotNull()).distinct()
    lengths = F.sequence(F.lit(0), F.length("_target"))
    begun = targets.withColumn("_prefix", F.explode(F.transform(lengths, lambda n: F.substring(F.col("_target"), F.lit(1), n))))
    allowed = begun.join(filed, ["project_hash", "_prefix"]).filter(F.rlike(F.col("_target"), F.col("_regex")))
    allowed = allowed.select(F.concat_ws("|", F.lit("p"), "project_hash", "_target").alias("_key")).distinct()
    # Other findings get keys of their own, so that they stay spread if the join has to shuffle.
    own = F.concat_ws("|", F.lit("-"), F.xxhash64("path", "rule_order").cast("string"))
    key = F.when(target.isNotNull() & F.col("project_hash").isNotNull(), F.concat_ws("|", F.lit("p"), "project_hash", target)).otherwise(own)
    return violations.withColumn("_key", key).join(allowed, "_key", "left_anti").select(violations.columns)


def apply_suppressions(violations: DataFrame, lines: DataFrame, enabled: bool = False) -> DataFrame:
    """Drops mock findings on lines with an allow comment; off unless asked for."""
    if not enabled:
        return violations
    commented = (
        lines.filter(F.col("line").rlike(ALLOW_COMMENT))
        .select("path", "line_num")
        .withColumn("violation_type", F.lit("mock_violation"))
    )
    return violations.join(commented, ["path", "line_num", "violation_type"], "left_anti")
