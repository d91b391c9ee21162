"""Roll-ups for people and tools: decisions, digests, profiles, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintlake.functions import paths as P

# The two decisions and their exit codes.
BLOCK, APPROVE = "block", "approve"
EXIT_CODES = {BLOCK: 2, APPROVE: 0}

# Tools whose events are about writing code.
CODING_TOOLS = ["Write", "Edit", "MultiEdit", "Task"]


def errors(violations: DataFrame) -> DataFrame:
    return violations.filter(F.col("severity") == "error")


def coding_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("tool_name").isin(CODING_TOOLS))


def error_line(name: Column, line_num: Column, message: Column, fix: Column) -> Column:
    """Fixed format: bullet, base name, line and message, then the advice if there is any."""
    head = F.concat(F.lit("• "), name, F.lit(":"), line_num.cast("string"), F.lit(" - "), message)
    return F.concat(head, F.when(F.coalesce(fix, F.lit("")) != "", F.concat(F.lit("\n  Fix: "), fix)).otherwise(""))


def format_violation(violations: DataFrame) -> DataFrame:
    """Adds ``text``: fixed display format of one finding."""
    head = F.format_string("📍 %s:%d - %s", P.base_name(F.col("path")), F.col("line_num"), F.col("message"))
    fix = F.coalesce(F.col("fix_suggestion"), F.lit(""))
    return violations.withColumn(
        "text", F.concat(head, F.when(fix != "", F.concat(F.lit("\n  💡 Fix: "), fix)).otherwise(""))
    )


def _reason(n_errors: Column, details: Column, fixes: Column | None) -> Column:
    blocked = F.concat(
        F.lit("Quality violations found ("), n_errors.cast("string"), F.lit(" errors):\n"), F.array_join(details, "\n")
    )
    passed = F.lit("Quality checks passed - no issues found")
    if fixes is not None:
        listed = F.array_join(F.transform(fixes, lambda fix: F.concat(F.lit("• "), fix)), "\n")
        passed = F.when(F.size(fixes) > 0, F.concat(F.lit("Quality checks passed with auto-fixes:\n"), listed)).otherwise(
            passed
        )
    return F.when(n_errors > 0, blocked).otherwise(passed)


def _decision(n_errors: Column, details: Column, fixes: Column | None = None) -> list[Column]:
    blocks = n_errors > 0
    return [
        F.when(blocks, BLOCK).otherwise(APPROVE).alias("decision"),
        F.when(blocks, EXIT_CODES[BLOCK]).otherwise(EXIT_CODES[APPROVE]).alias("exit_code"),
        n_errors.cast("long").alias("n_errors"),
        _reason(n_errors, details, fixes).alias("reason"),
    ]


def decision_columns(name: Column, found: Column) -> list[Column]:
    """Decision of one file from the array of its errors; the reason lists them in rule order."""
    entries = F.transform(
        found,
        lambda f: F.struct(
            f["rule_order"].alias("rule_order"),
            f["line_num"].alias("line_num"),
            error_line(name, f["line_num"], f["message"], f["fix_suggestion"]).alias("text"),
        ),
    )
    return _decision(F.size(found), F.transform(F.array_sort(entries), lambda e: e["text"]))


def _error_entries(violations: DataFrame) -> DataFrame:
    line = error_line(P.base_name(F.col("path")), F.col("line_num"), F.col("message"), F.col("fix_suggestion"))
    return errors(violations).select("path", "rule_order", "line_num", line.alias("text"))


# Orders of one file that are numbered by one task; see numbered_errors.
_STRETCH = 100_000


def numbered_errors(violations: DataFrame) -> DataFrame:
    """(path, position, text): the errors of each file as lines of its reason, numbered from 0 in rule order.

    The orders of a file are cut into stretches.  Errors are counted per stretch, combined before
    the shuffle, and numbered within theirs, so no task holds a file with very many errors.
    """
    entries = _error_entries(violations).withColumn("_stretch", F.expr(f"rule_order div {_STRETCH}"))
    counts = entries.groupBy("path", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("path").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("path", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("path", "_stretch").orderBy("rule_order", "line_num", "text"))
    numbered = entries.withColumn("_local", local).join(before, ["path", "_stretch"])
    return numbered.select("path", (F.col("_before") + F.col("_local") - 1).alias("position"), "text")


def decide_pages(violations: DataFrame, files: DataFrame, page_errors: int = 1000) -> DataFrame:
    """The rows of :func:`decide` with the reason in pages of at most ``page_errors`` errors.

    (path, decision, exit_code, n_errors, page, reason): pages count from 0, and a file's pages
    joined by newlines are its whole reason.  No row and no task grows with the errors of one file.
    """
    numbered = numbered_errors(violations).withColumn("page", F.expr(f"position div {page_errors}"))
    pages = numbered.groupBy("path", "page").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("lines"))
    totals = errors(violations).groupBy("path").agg(F.count(F.lit(1)).alias("total"))
    kept = files.select("path", *(["fixes"] if "fixes" in files.columns else []))
    joined = kept.join(totals, "path", "left").join(pages, "path", "left")
    fixes = F.coalesce(F.col("fixes"), F.array().cast("array<string>")) if "fixes" in files.columns else None
    text = F.transform("lines", lambda e: e["text"])
    rows = joined.select(
        "path",
        *_decision(F.coalesce("total", F.lit(0)), text, fixes),
        F.coalesce("page", F.lit(0)).alias("page"),
        F.array_join(text, "\n").alias("_more"),
    )
    return rows.withColumn("reason", F.when(F.col("page") == 0, F.col("reason")).otherwise(F.col("_more"))).drop("_more")


def decide(violations: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file: block iff it has an error; the reason lists its errors in rule order.

    ``files`` may carry ``fixes`` (ARRAY<STRING>), the fixes applied to each file.  Only
    errors are shuffled, and the reason of a file is bounded by that file's own errors; where
    those have no bound, :func:`decide_pages` gives the reason in pages.
    """
    blocking = _error_entries(violations).select("path", F.struct("rule_order", "line_num", "text").alias("entry"))
    per_file = blocking.groupBy("path").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    has_fixes = "fixes" in files.columns
    joined = files.select("path", *(["fixes"] if has_fixes else [])).join(per_file, "path", "left")
    n_errors = F.when(F.col("entries").isNull(), 0).otherwise(F.size("entries"))
    fixes = F.coalesce(F.col("fixes"), F.array().cast("array<string>")) if has_fixes else None
    return joined.select("path", *_decision(n_errors, F.transform("entries", lambda e: e["text"]), fixes))


def scan_profile(violations: DataFrame, *by: str) -> DataFrame:
    return violations.groupBy(*by, "violation_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def reminders(df: DataFrame) -> DataFrame:
    """Each reminder once per run."""
    return df.select("run_id", "reminder").distinct()


def project_digest(summary: DataFrame, days: int = 7) -> DataFrame:
    """(project_hash, digest): the summary of a project over ``days`` as text, in a fixed format."""
    issues = F.transform(
        "top_issues",
        lambda i: F.concat(
            F.lit("- **"), i["type"], F.lit("** ("), i["count"].cast("string"), F.lit("x): "), F.coalesce(i["fix"], F.lit(""))
        ),
    )
    files = F.transform(
        "problem_files",
        lambda f: F.concat(F.lit("- "), f["file"], F.lit(": "), f["violations"].cast("string"), F.lit(" violations")),
    )
    has_issues = F.coalesce(F.size("top_issues") > 0, F.lit(False))
    has_files = F.coalesce(F.size("problem_files") > 0, F.lit(False))
    parts = F.array_compact(
        F.array(
            F.lit("# MEMORY:\n"),
            F.when(has_issues, F.concat(F.lit(f"## Recent Violation Patterns (Last {days} Days)\n\n"), F.array_join(issues, "\n"), F.lit("\n"))),
            F.when(has_files, F.concat(F.lit("## Files Needing Attention\n\n"), F.array_join(files, "\n"), F.lit("\n"))),
            F.when(~has_issues & ~has_files, F.lit("No violations logged yet.\n")),
        )
    )
    return summary.select("project_hash", F.array_join(parts, "\n").alias("digest"))


def inject_context(events: DataFrame, digests: DataFrame) -> DataFrame:
    """Coding events with the digest of their project as approval reason; others are dropped.

    ``events`` carry project_hash.  There is one digest per project, so the digests are the
    side that is repeated when a project is hot.
    """
    from lintlake.functions.joins import salted_join

    coding = coding_events(events)
    joined = salted_join(coding, digests.select("project_hash", "digest"), ["project_hash"])
    return joined.filter(F.col("digest") != "").withColumn("decision", F.lit(APPROVE)).withColumnRenamed("digest", "reason")
