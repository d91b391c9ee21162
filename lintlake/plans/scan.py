"""The corpus scan: a table of files to a table of findings, in one narrow pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.findings import explode_findings, no_findings
from lintlake.operators.corpus import gate_findings, route_language, with_gate
from lintlake.operators.fact_rules import FactRule, fact_findings, needed_facts, with_test_flags
from lintlake.operators.facts import with_facts
from lintlake.operators.file_rules import FileRule, file_findings
from lintlake.operators.line_rules import line_findings, with_naming_flag
from lintlake.operators.rulebook import LineRule

# A language pack of the caller: (path, language, text) columns to ARRAY<finding>.
Pack = Callable[[Column, Column, Column], Column]


def prepare(
    files: DataFrame, extensions: dict[str, str] | None = None, strict_case: bool = True, max_bytes: int | None = None
) -> DataFrame:
    """Routed and gated files with the columns the rules read."""
    return with_gate(route_language(files, extensions, strict_case), max_bytes=max_bytes)


def with_findings(
    files: DataFrame,
    rules: list[LineRule] | None = None,
    packs: dict[str, Pack] | None = None,
    extensions: dict[str, str] | None = None,
    max_bytes: int | None = None,
    fact_rules: list[FactRule] | None = None,
    file_rules: list[FileRule] | None = None,
) -> DataFrame:
    """One row per routed file with ``findings``, the array of everything found in it.

    ``rules``, ``fact_rules`` and ``file_rules`` replace the built-in ones; the parser only
    writes down the facts that the rules look at.  The files are read once.  Only the text of Python files crosses to the Python workers,
    once.  There is no shuffle, so one huge source or directory is no different from many
    small ones, and the same plan runs on a stream.
    """
    path, language, text = F.col("path"), F.col("language"), F.col("text")
    routed = prepare(files, extensions, max_bytes=max_bytes)
    prepared = with_naming_flag(with_test_flags(with_facts(routed, needed_facts(fact_rules))))
    parts = [
        gate_findings(path, F.col("gate"), F.col("gate_bytes"), max_bytes),
        fact_findings(fact_rules),
        line_findings(rules),
        file_findings(file_rules),
    ]
    for name, pack in (packs or {}).items():
        parts.append(F.when(language == name, pack(path, language, text)))
    found = F.concat(*[F.coalesce(part, no_findings()) for part in parts])
    inner = {"text", "content", "facts", "gate_bytes", "test_strict", "test_loose", "test_naming"}
    # A generator of one row: filters on the result stay above it.  On a plain column they
    # would be pushed down together with a second copy of all rules.
    once = F.inline_outer(F.array(F.struct(found.alias("findings"))))
    return prepared.select(*[c for c in prepared.columns if c not in inner], once)


def scan_all(
    files: DataFrame,
    config: DataFrame | None = None,
    rules: list[LineRule] | None = None,
    packs: dict[str, Pack] | None = None,
    extensions: dict[str, str] | None = None,
    keep: tuple[str, ...] = (),
    max_bytes: int | None = None,
    fact_rules: list[FactRule] | None = None,
    file_rules: list[FileRule] | None = None,
) -> DataFrame:
    """All findings of all rules; equal findings on one line stay separate rows.

    ``config`` (project_hash, allowed_patterns) needs ``project_hash`` among ``keep``.
    """
    found = with_findings(files, rules, packs, extensions, max_bytes, fact_rules, file_rules)
    rows = explode_findings(found, F.col("findings"), *keep)
    if config is None:
        return rows
    from lintlake.operators.allow_list import apply_allow_list

    return apply_allow_list(rows, config)


def scan_decisions(files: DataFrame, rules: list[LineRule] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Block or approve per file, straight from the scan: the flagship, without a shuffle."""
    from lintlake.operators.reports import decision_columns

    found = with_findings(files, rules, max_bytes=max_bytes)
    errors = F.filter("findings", lambda f: f["severity"] == "error")
    return found.select("path", "language", *decision_columns(P.base_name(F.col("path")), errors))
