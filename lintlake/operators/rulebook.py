"""The rule tables: banned names and line patterns, plain data that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lintlake.functions.text import quoted

# Name tables per language, in table order (the first match wins).
# The advice texts are ours.
BANNED_NAMES: dict[str, dict[str, str]] = {
    "python": {
        "requests": "Switch to httpx for HTTP calls",
        "urllib": "Switch to httpx for HTTP calls",
        "pip": "Let uv manage packages",
        "pip-tools": "Let uv manage packages",
        "poetry": "Let uv manage packages",
        "pipenv": "Let uv manage packages",
        "conda": "Let uv manage packages",
        "virtualenv": "Let uv manage environments",
        "venv": "Let uv manage environments",
        "pyenv": "Let uv manage Python versions",
        "setuptools": "Describe the build in pyproject.toml and run it with uv",
        "distutils": "Describe the build in pyproject.toml and run it with uv",
        "nose": "Write the tests for pytest",
        "nose2": "Write the tests for pytest",
        "unittest": "Write the tests for pytest",
        "pylint": "Lint with ruff",
        "flake8": "Lint with ruff",
        "black": "Format with ruff",
        "isort": "Sort imports with ruff",
        "autopep8": "Format with ruff",
        "yapf": "Format with ruff",
        "sphinx": "Write the documentation with mkdocs",
        "pandas": "Use polars for data frames",
        "os.path": "Use pathlib for paths",
    },
    "typescript": {
        "moment": "Use date-fns for dates",
        "axios": "Call the built-in fetch",
        "lodash": "Use the built-in array and object methods",
        "request": "Call the built-in fetch",
        "underscore": "Use the built-in array and object methods",
    },
    "rust": {
        "time": "Use chrono or std::time",
        "rand": "Move to a current rand release",
        "tempdir": "Use the tempfile crate",
        "error-chain": "Use thiserror or anyhow",
    },
    "go": {
        "io/ioutil": "Call the io and os packages directly",
        "github.com/pkg/errors": "Wrap errors with fmt.Errorf and %w",
    },
}

# Advice for a plain ``unittest`` import inside a test file.
UNITTEST_IN_TESTS = "Use pytest fixtures; unittest.mock itself may stay in tests"

# Dotted names that are never reported, and those allowed in test files.
NEVER_BANNED = ["urllib.parse"]
ALLOWED_IN_TESTS = ["unittest.mock"]


@dataclass(frozen=True)
class LineRule:
    """One pattern tried on every line of one language.

    ``{name}`` in ``message`` is the captured group; with ``names`` set, the rule only fires
    when that name (cut at ``cut``, if given) is in the table, whose value is the advice.
    """

    violation_type: str
    language: str
    pattern: str
    severity: str
    message: str
    fix: str = ""
    # Text every matching line contains; files without it are not split at all.
    needle: str = ""
    group: int = 0
    cut: str = ""
    context_key: str = "line_content"
    names: dict[str, str] | None = None
    test_files_only: bool = False
    order: int = 0
    extra_context: dict[str, str] = field(default_factory=dict)


# The line patterns, as Python regexes.
LINE_RULES: list[LineRule] = [
    LineRule(
        "test_naming_convention",
        "python",
        r"^def \s*((?!_|test_)\w+)\s*\(",
        "warning",
        "Test helper '{name}' does not follow the test_ naming scheme",
        "Name tests test_<what>_<when>, or mark helpers with a leading underscore",
        needle="def ",
        group=1,
        context_key="function_name",
        test_files_only=True,
        order=0,
    ),
    LineRule(
        "antipattern",
        "python",
        r"import\s+threading",
        "warning",
        "Threads speed up waiting, not computing",
        needle="threading",
        context_key="line",
        extra_context={"pattern": r"import\s+threading"},
        order=1,
    ),
    LineRule(
        "banned_package_import",
        "typescript",
        r"^\s*+import\s.*\sfrom\s++['\"]([^'\"]++)['\"]",
        "error",
        "Banned package '{name}'",
        needle="import",
        group=1,
        cut="/",
        context_key="package",
        names=BANNED_NAMES["typescript"],
        order=0,
    ),
    LineRule(
        "console_usage",
        "typescript",
        r"\bconsole\.(log|warn|error|debug|info)\(",
        "warning",
        "Console output left in the code",
        "Send messages through a logging library",
        needle="console.",
        order=1,
    ),
    LineRule(
        "banned_crate_usage",
        "rust",
        r"^\s*use\s+([a-zA-Z_][a-zA-Z0-9_]*)",
        "error",
        "Banned crate '{name}'",
        needle="use",
        group=1,
        context_key="crate",
        names=BANNED_NAMES["rust"],
        order=0,
    ),
    LineRule(
        "banned_package_usage",
        "go",
        r"import\s+\"([^\"]+)\"",
        "error",
        "Banned package '{name}'",
        needle="import",
        group=1,
        context_key="package",
        names=BANNED_NAMES["go"],
        order=0,
    ),
    LineRule(
        "panic_abuse",
        "go",
        r"\bpanic\s*\(",
        "error",
        "panic() used in place of an error value",
        "Return the error and let the caller decide",
        needle="panic",
        order=1,
    ),
    LineRule(
        "error_ignoring",
        "go",
        r",\s*_\s*:=",
        "warning",
        "A returned value, probably an error, is dropped with _",
        "Name the error and check it",
        needle=":=",
        order=2,
    ),
]

# Style patterns that are reported as coverage, never enforced.
REQUIRED_PATTERNS: dict[str, str] = {
    "f_strings": r"f[\"'].*\{.*\}.*[\"']",
    "pathlib_usage": r"from pathlib import Path|Path\(",
    "type_hints": r"def \w+\([^)]*\) -> ",
    "context_managers": r"with open\(",
}

# Names the mock rules look for.
MOCK_CALLS = ["patch", "mock_patch", "mock.patch", "unittest.patch"]
MOCK_CONSTRUCTORS = ["Mock", "MagicMock", "AsyncMock", "PropertyMock"]


def rules_for(*violation_types: str) -> list[LineRule]:
    return [rule for rule in LINE_RULES if rule.violation_type in violation_types]


def _literal_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of constants whose size Spark knows, so joins with it are planned on that size."""
    values = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def banned_names(spark: SparkSession) -> DataFrame:
    """(language, name, suggestion, rank); rank is the table order."""
    rows = [
        (language, name, advice, rank)
        for language, names in BANNED_NAMES.items()
        for rank, (name, advice) in enumerate(names.items())
    ]
    return _literal_table(spark, "language, name, suggestion, rank", rows)


def rule_catalog(spark: SparkSession) -> DataFrame:
    """(catalog, language, name, detail): banned names, line patterns and style patterns."""
    rows = [
        ("banned_name", language, name, advice)
        for language, names in BANNED_NAMES.items()
        for name, advice in names.items()
    ]
    rows += [("line_rule", rule.language, rule.violation_type, rule.pattern) for rule in LINE_RULES]
    rows += [("required_pattern", "python", name, regex) for name, regex in REQUIRED_PATTERNS.items()]
    return _literal_table(spark, "catalog, language, name, detail", rows)
