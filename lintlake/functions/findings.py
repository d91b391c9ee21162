"""Building blocks for rules that return an array of findings per file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import quoted
from lintlake.schemas import FINDING, FINDINGS

# Findings of one file keep this order in reports: syntax rules, line rules,
# whole-file rules, imported reports; then source order inside a group.
GATES, SYNTAX, LINES, WHOLE_FILE, REPORTS = range(5)


def order_key(group: int, position: Column) -> Column:
    return F.lit(group) * F.lit(10_000_000_000) + position.cast("long")


def finding(
    line_num: Column | int,
    violation_type: Column | str,
    severity: Column | str,
    message: Column | str,
    fix: Column | str = "",
    context: Mapping[str, Column | str] | None = None,
    order: Column | None = None,
) -> Column:
    def as_col(value: Column | str | int) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    line = as_col(line_num).cast("int")
    entries = [part for key, value in (context or {}).items() for part in (F.lit(key), as_col(value).cast("string"))]
    language_context = F.create_map(*entries) if entries else F.create_map()
    return F.struct(
        line.alias("line_num"),
        as_col(violation_type).alias("violation_type"),
        as_col(message).alias("message"),
        as_col(fix).alias("fix_suggestion"),
        as_col(severity).alias("severity"),
        F.lit(None).cast("string").alias("function_name"),
        language_context.cast("map<string,string>").alias("language_context"),
        (order if order is not None else order_key(REPORTS, line)).alias("rule_order"),
    )


def finding_sql(
    line_num: str, violation_type: str, severity: str, message: str, fix: str, context: Mapping[str, str], order: str
) -> str:
    """The same struct as :func:`finding`, as SQL text; all arguments are SQL expressions."""
    entries = ", ".join(f"{quoted(key)}, CAST({value} AS STRING)" for key, value in context.items())
    return (
        f"named_struct('line_num', CAST({line_num} AS INT), 'violation_type', {violation_type}, 'message', {message}, "
        f"'fix_suggestion', {fix}, 'severity', {severity}, 'function_name', CAST(NULL AS STRING), "
        f"'language_context', CAST(map({entries}) AS MAP<STRING, STRING>), 'rule_order', CAST({order} AS BIGINT))"
    )


NO_FINDINGS_SQL = f"CAST(array() AS {FINDINGS.simpleString()})"


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def explode_findings(files: DataFrame, findings: Column, *keep: str) -> DataFrame:
    """One row per finding, with the file's path and language in front.

    The outer form is meant: for the inner one Catalyst infers a filter on the array's size
    and pushes it down, which would evaluate all rules of a file three times.
    """
    columns = ["path", "language", *keep]
    rows = files.select(*columns, F.inline_outer(findings)).filter(F.col("violation_type").isNotNull())
    return rows.select(*columns, *FINDING.fieldNames())


def explode_items(df: DataFrame, keep: list[str], items: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """(keep..., pos, item) for every non-null entry of an array that is costly to compute.

    Outer for the same reason: the array (a split, a parsed document) is computed once.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return rows.filter(F.col(item).isNotNull())
