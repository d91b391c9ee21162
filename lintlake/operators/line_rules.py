"""Line-pattern and banned-name rules.

One definition (:class:`LineRule`), two ways to run it:

* :func:`line_findings` - an array expression over one file's text, used by the full scan:
  no explode, no shuffle, and a file without a rule's needle is never split;
* :func:`apply_line_rules` - over an exploded ``lines`` table, one output row per hit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.functions.findings import LINES, NO_FINDINGS_SQL, explode_findings, finding_sql
from lintlake.functions.joins import salted_join
from lintlake.functions.text import quoted
from lintlake.operators.rulebook import LINE_RULES, LineRule, rules_for


def _regex(pattern: str) -> str:
    return quoted(X.py_regex(pattern))


def _hit_sql(rule: LineRule, line: str, line_num: str) -> str:
    """SQL text: the rule's finding on this line, or null."""
    fires = f"{line} RLIKE {_regex(rule.pattern)}"
    if rule.test_files_only:
        fires = f"test_naming AND {fires}"
    entity = X.py_strip_sql(line)
    if rule.group:
        entity = f"regexp_extract({line}, {_regex(rule.pattern)}, {rule.group})"
        entity = f"substring_index({entity}, {quoted(rule.cut)}, 1)" if rule.cut else entity
    fix = quoted(rule.fix)
    if rule.names is not None:
        table = ", ".join(f"{quoted(name)}, {quoted(advice)}" for name, advice in rule.names.items())
        fix = f"try_element_at(map({table}), {entity})"
        fires = f"{fires} AND {fix} IS NOT NULL"
    before, found, after = rule.message.partition("{name}")
    row = finding_sql(
        line_num,
        quoted(rule.violation_type),
        quoted(rule.severity),
        f"concat({quoted(before)}, {entity}, {quoted(after)})" if found else quoted(rule.message),
        fix,
        {rule.context_key: entity, **{key: quoted(value) for key, value in rule.extra_context.items()}},
        f"{LINES} * 10000000000 + {rule.order} * 1000000000 + {line_num}",
    )
    return f"CASE WHEN {fires} THEN {row} END"


def _hits_sql(rules: list[LineRule], line: str, line_num: str) -> str:
    return f"array_compact(array({', '.join(_hit_sql(rule, line, line_num) for rule in rules)}))"


def _any_of(rules: Iterable[LineRule]) -> str:
    return _regex("|".join(f"(?:{rule.pattern})" for rule in rules))


def _by_language(rules: Iterable[LineRule]) -> list[tuple[str, list[LineRule]]]:
    ordered = sorted(rules, key=lambda rule: rule.language)
    return [(language, list(group)) for language, group in groupby(ordered, key=lambda rule: rule.language)]


def _needles_sql(rules: list[LineRule]) -> str:
    """Some rule may fire: a cheap search of the whole text before it is split."""
    tests = [
        f"(test_naming AND contains(text, {quoted(rule.needle)}))" if rule.test_files_only
        else f"contains(text, {quoted(rule.needle)})"
        for rule in rules
    ]
    return f"({' OR '.join(tests)})"


def with_naming_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("test_naming", P.is_test_naming(F.col("path")))


def line_findings(rules: list[LineRule] | None = None) -> Column:
    """ARRAY of findings of all line rules on one file with language, text and test_naming."""
    branches = ""
    for name, group in _by_language(LINE_RULES if rules is None else rules):
        numbered = f"transform({X.line_array_sql('text')}, (l, i) -> named_struct('line_num', i + 1, 'line', l))"
        candidates = f"filter({numbered}, x -> x.line RLIKE {_any_of(group)})"
        found = f"flatten(transform({candidates}, x -> {_hits_sql(group, 'x.line', 'x.line_num')}))"
        branches += f" WHEN language = {quoted(name)} AND {_needles_sql(group)} THEN {found}"
    return F.expr(f"CASE{branches} ELSE {NO_FINDINGS_SQL} END" if branches else NO_FINDINGS_SQL)


def apply_line_rules(lines: DataFrame, rules: list[LineRule] | None = None, *keep: str) -> DataFrame:
    """Findings of several rules over (path, language, line_num, line), in one pass.

    The joint pattern drops most lines before any finding is built.
    """
    groups = _by_language(LINE_RULES if rules is None else rules)
    wanted = " OR ".join(f"(language = {quoted(name)} AND line RLIKE {_any_of(group)})" for name, group in groups)
    hits = " ".join(f"WHEN {quoted(name)} THEN {_hits_sql(group, 'line', 'line_num')}" for name, group in groups)
    return explode_findings(with_naming_flag(lines.filter(wanted)), F.expr(f"CASE language {hits} END"), *keep)


NAME_RULES = [rule for rule in LINE_RULES if rule.names is not None]


def banned_name_lookup(lines: DataFrame, banned_names: DataFrame, rules: list[LineRule] | None = None) -> DataFrame:
    """The name rules against a table (language, name, suggestion), all languages in one pass.

    Only imported names reach the join.  Spark broadcasts the table only below its size
    threshold; a larger one meets salted candidates, because a popular name may be everywhere.
    """
    chosen = NAME_RULES if rules is None else rules
    candidates = apply_line_rules(lines, [replace(rule, names=None) for rule in chosen])
    keys = sorted({rule.context_key for rule in chosen})
    name = F.coalesce(*[F.try_element_at("language_context", F.lit(key)) for key in keys])
    table = banned_names.select("language", "name", F.col("suggestion").alias("advice"))
    matched = salted_join(candidates.withColumn("name", name), table, ["language", "name"])
    return matched.withColumn("fix_suggestion", F.col("advice")).select(candidates.columns)


def _with_names(lines: DataFrame, kind: str, banned_names: DataFrame | None) -> DataFrame:
    if banned_names is None:
        return apply_line_rules(lines, rules_for(kind))
    return banned_name_lookup(lines, banned_names, rules_for(kind))


def rule_banned_package_import(lines: DataFrame, banned_names: DataFrame | None = None) -> DataFrame:
    return _with_names(lines, "banned_package_import", banned_names)


def rule_console_usage(lines: DataFrame) -> DataFrame:
    return apply_line_rules(lines, rules_for("console_usage"))


def rule_banned_crate_usage(lines: DataFrame, banned_names: DataFrame | None = None) -> DataFrame:
    return _with_names(lines, "banned_crate_usage", banned_names)


def rule_banned_package_usage(lines: DataFrame, banned_names: DataFrame | None = None) -> DataFrame:
    return _with_names(lines, "banned_package_usage", banned_names)


def rule_panic_abuse(lines: DataFrame) -> DataFrame:
    return apply_line_rules(lines, rules_for("panic_abuse"))


def rule_error_ignoring(lines: DataFrame) -> DataFrame:
    return apply_line_rules(lines, rules_for("error_ignoring"))


def rule_antipattern(lines: DataFrame) -> DataFrame:
    return apply_line_rules(lines, rules_for("antipattern"))


def rule_test_naming_convention(lines: DataFrame) -> DataFrame:
    return apply_line_rules(lines, rules_for("test_naming_convention"))
