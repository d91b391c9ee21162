"""Rules on the whole text of a Python file: narrow array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.functions.findings import NO_FINDINGS_SQL, WHOLE_FILE, explode_findings, finding_sql
from lintlake.functions.text import quoted
from lintlake.operators.rulebook import REQUIRED_PATTERNS

# A quote, then %s or %d, then a quote, on one line.  Only the first % code after the first
# quote needs to be tried, so the match is linear in the length of the line.
OLD_FORMATTING = r"(?m)(?d)^[^\"'\n]*+[\"'](?>.*?%[sd]).*[\"']"


# The style patterns again, each matched in linear time: the earliest start on a line is the
# only one that needs to be followed, so the groups never give text back.
LINEAR_REQUIRED = {
    **REQUIRED_PATTERNS,
    "f_strings": r"(?m)^(?>[^\n]*?f[\"'])(?>[^\n]*?\{)(?>[^\n]*?\}).*[\"']",
}



@dataclass(frozen=True)
class FileRule:
    """A finding on line 1 when ``when``, SQL over ``text``, holds.

    ``bind`` is a (name, SQL) pair computed once, after ``guard`` has let the file through.
    ``context`` holds SQL; ``language`` names the files the rule looks at.
    """

    violation_type: str
    when: str
    message: str
    fix: str
    context: dict[str, str]
    guard: str = "true"
    bind: tuple[str, str] | None = None
    severity: str = "warning"
    language: str = "python"


# Something other than blanks must follow "class", because the trimmed line is looked at.
_CLASS_LINE = quoted(f"(?U)(?s)^{X.BLANK}*class .*[^\\s\\x1C-\\x1F]")
_COUNTS = X.let_sql(
    X.line_array_sql("text"),
    "lines",
    f"named_struct('classes', size(filter(lines, l -> l RLIKE {_CLASS_LINE})), 'inherits', "
    "size(filter(lines, l -> contains(lower(l), ' inheritance ') OR contains(l, 'super()'))))",
)

missing_pathlib = FileRule(
    "missing_pathlib",
    "(contains(text, 'open(') OR contains(lower(text), 'file')) AND NOT contains(text, 'pathlib')",
    "File handling without pathlib",
    "Import Path from pathlib",
    {"missing_import": "'pathlib'"},
)
old_formatting = FileRule(
    "old_formatting",
    f"NOT contains(text, 'f\"') AND text RLIKE {quoted(OLD_FORMATTING)}",
    "Percent-style formatting",
    "Use f-strings",
    {"formatting_style": "'old_percent'"},
    guard="contains(text, '%s') OR contains(text, '%d')",
)
error_handling = FileRule(
    "error_handling",
    "contains(text, 'except Exception') AND NOT contains(lower(text), 'log')",
    "Broad except without logging",
    "Log the exception with its context",
    {"pattern": "'exception_without_logging'"},
)
composition_violation = FileRule(
    "composition_violation",
    "n.classes > 0 AND n.inherits > n.classes * 0.5D",
    "More inheritance than classes call for",
    "Compose objects in place of inheriting",
    {"class_count": "n.classes", "inheritance_count": "n.inherits"},
    guard="contains(text, 'class ') AND (contains(text, 'super()') OR contains(lower(text), ' inheritance '))",
    bind=("n", _COUNTS),
)

FILE_RULES = [missing_pathlib, old_formatting, error_handling, composition_violation]


def _findings_sql(rule: FileRule, rank: int) -> str:
    row = finding_sql(
        "1",
        quoted(rule.violation_type),
        quoted(rule.severity),
        quoted(rule.message),
        quoted(rule.fix),
        rule.context,
        f"{WHOLE_FILE} * 10000000000 + {rank}",
    )
    judged = f"CASE WHEN {rule.when} THEN array({row}) ELSE {NO_FINDINGS_SQL} END"
    judged = X.let_sql(rule.bind[1], rule.bind[0], judged) if rule.bind else judged
    return f"CASE WHEN {rule.guard} THEN {judged} ELSE {NO_FINDINGS_SQL} END"


def file_findings(rules: list[FileRule] | None = None) -> Column:
    """ARRAY of findings of the whole-file rules on one file with language and text."""
    by_language: dict[str, list[str]] = {}
    for position, rule in enumerate(FILE_RULES if rules is None else rules):
        rank = FILE_RULES.index(rule) if rule in FILE_RULES else len(FILE_RULES) + position
        by_language.setdefault(rule.language, []).append(_findings_sql(rule, rank))
    branches = " ".join(
        f"WHEN language = {quoted(name)} THEN concat({', '.join(found)})" for name, found in by_language.items()
    )
    return F.expr(f"CASE WHEN text IS NULL THEN NULL {branches} END" if branches else NO_FINDINGS_SQL)


def apply_file_rules(files: DataFrame, *rules: FileRule) -> DataFrame:
    """Findings of the given rules (default: all) over (path, language, text)."""
    chosen = list(rules) or FILE_RULES
    languages = sorted({rule.language for rule in chosen})
    return explode_findings(files.filter(F.col("language").isin(languages)), file_findings(chosen))


def _python(files: DataFrame, rule: FileRule) -> DataFrame:
    return apply_file_rules(files, rule)


def rule_missing_pathlib(files: DataFrame) -> DataFrame:
    return _python(files, missing_pathlib)


def rule_old_formatting(files: DataFrame) -> DataFrame:
    return _python(files, old_formatting)


def rule_error_handling(files: DataFrame) -> DataFrame:
    return _python(files, error_handling)


def rule_composition_violation(files: DataFrame) -> DataFrame:
    return _python(files, composition_violation)


def required_pattern_coverage(files: DataFrame, *by: str) -> DataFrame:
    """Files per group and, for each style pattern, how many of them use it and what share."""
    flags = {
        name: F.col("text").rlike(X.py_regex(regex)).cast("int") for name, regex in LINEAR_REQUIRED.items()
    }
    marked = files.filter(F.col("language") == "python").select(*by, *[f.alias(n) for n, f in flags.items()])
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.sum(name).alias(f"{name}_files") for name in flags],
        *[(F.sum(name) / F.count(F.lit(1))).alias(f"{name}_share") for name in flags],
    )
