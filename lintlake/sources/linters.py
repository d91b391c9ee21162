"""Reports of common linters and compilers as findings.

Every importer takes (path, json) or (path, line), where path is the file the tool was run
on, and returns findings.  All of them are narrow: a report names its file, so no join is
needed.  A report that cannot be read gives no rows and never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.findings import REPORTS, explode_findings, explode_items, finding, order_key
from lintlake.functions.text import py_strip
from lintlake.operators.projects import nearest_config

RUFF = (
    "array<struct<code:string, message:string, fix:struct<message:string>, location:struct<row:int, column:int>>>"
)
ESLINT_MESSAGE = "struct<ruleId:string, severity:int, message:string, line:int, column:int, fix:string>"
ESLINT = f"array<struct<filePath:string, messages:array<{ESLINT_MESSAGE}>>>"
CLIPPY_SPAN = "struct<file_name:string, line_start:int, column_start:int>"
CLIPPY = (
    "reason string, message struct<message:string, level:string, code:struct<code:string>, "
    f"spans:array<{CLIPPY_SPAN}>>"
)
GOLANGCI = "Issues array<struct<FromLinter:string, Text:string, Pos:struct<Filename:string, Line:int, `Column`:int>>>"

# Rules that test files may break once the project says so.
RUFF_TEST_CODES = {
    "S101": "assert statements, normal in tests",
    "S603": "subprocess without a shell, safe in tests",
    "S607": "subprocess with a relative program, acceptable in tests",
}

# Type name and language of the rows that stand for a failed tool run.
TOOL_LANGUAGES = {"eslint": "typescript", "tsc": "typescript", "clippy": "rust", "golangci": "go"}

# Fixed value: a compiler error line, "file(line,column): error TSnnnn: text".
TSC_LINE = r"^.*\((\d+),(\d+)\):\s+error\s+(TS\d+):\s+(.+)"
# Fixed value: how a type checker marks an error line.
MYPY_ERROR = r":\s*error:"


def _or(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def _array_of(json: str, schema: str) -> Column:
    """The parsed document if it is an array; Spark would also take a single object for one."""
    return F.from_json(F.when(F.col(json).rlike(r"^\s*\["), F.col(json)), schema)


def _report_rows(df: DataFrame, language: str, row: Column) -> DataFrame:
    return explode_findings(df.withColumn("language", F.lit(language)), F.array(row))


def test_file_advice(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RUFF_TEST_CODES.items() for x in pair])
    return F.concat(
        F.lit("Configure per-file-ignores for tests in pyproject.toml: "),
        code,
        F.lit(" ("),
        F.try_element_at(table, code),
        F.lit(")"),
    )


def import_ruff(df: DataFrame) -> DataFrame:
    """ruff JSON; in test files some codes get configuration advice (``is_test_override``)."""
    items = explode_items(df, ["path"], _array_of("json", RUFF))
    code = _or(F.col("item.code"), "")
    message = _or(F.col("item.message"), "Ruff violation")
    override = P.is_test_strict(F.col("path")) & code.isin(list(RUFF_TEST_CODES))
    fix = F.when(override, test_file_advice(code)).otherwise(_or(F.col("item.fix.message"), ""))
    row = finding(
        _or(F.col("item.location.row"), 0),
        code,
        "error",
        message,
        fix,
        {"is_test_override": override},
        order=order_key(REPORTS, F.col("pos")),
    )
    return _report_rows(items.filter(~F.contains(message, F.lit("SyntaxError"))), "python", row)


def import_eslint(df: DataFrame) -> DataFrame:
    """ESLint JSON, errors only; a bulk report names the file of each entry itself."""
    entries = explode_items(df, ["path"], _array_of("json", ESLINT), "_n", "entry")
    named = F.coalesce(F.nullif(F.col("entry.filePath"), F.lit("")), F.col("path"))
    entries = entries.select(named.alias("path"), F.col("entry.messages").alias("messages"))
    items = explode_items(entries, ["path"], F.col("messages")).filter(F.col("item.severity") == 2)
    rule = F.col("item.ruleId")
    row = finding(
        _or(F.col("item.line"), 0),
        F.concat(F.lit("eslint_"), _or(rule, "unknown")),
        "error",
        _or(F.col("item.message"), "ESLint error"),
        _or(F.col("item.fix"), ""),
        {"rule_id": rule, "column": F.col("item.column")},
        order=order_key(REPORTS, F.col("pos")),
    )
    return _report_rows(items, "typescript", row)


def import_tsc(df_lines: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """tsc output lines; errors where the project has a configuration, warnings elsewhere.

    ``markers`` (dir, marker) tells where tsconfig.json files are.  They are looked up once per file, and
    only files that have one are joined to the lines.
    """
    hits = df_lines.filter(F.col("line").rlike(TSC_LINE))
    if markers is None:
        hits = hits.withColumn("config_dir", F.lit(None).cast("string"))
    else:
        configured = nearest_config(df_lines.select("path").distinct(), markers, "tsconfig.json").filter("config_dir IS NOT NULL")
        hits = hits.join(configured, "path", "left")
    line_num, column, code, text = (F.regexp_extract("line", TSC_LINE, i) for i in (1, 2, 3, 4))
    row = finding(
        line_num.try_cast("int"),
        F.concat(F.lit("typescript_"), code),
        F.when(F.col("config_dir").isNotNull(), "error").otherwise("warning"),
        F.concat(F.lit("TypeScript: "), text),
        "",
        {"error_code": code, "column": column.try_cast("int")},
    )
    return _report_rows(hits, "typescript", row)


def import_clippy(df_lines: DataFrame) -> DataFrame:
    """Clippy JSON lines: first span of each compiler message about the scanned file."""
    parsed = df_lines.select("path", F.from_json("line", CLIPPY).alias("m")).filter(
        (F.col("m.reason") == "compiler-message") & F.col("m.message.level").isin("error", "warning")
    )
    placed = parsed.withColumn("span", F.try_element_at("m.message.spans", F.lit(1))).filter(
        P.base_name(F.col("span.file_name")) == P.base_name(F.col("path"))
    )
    code = _or(F.col("m.message.code.code"), "unknown")
    row = finding(
        _or(F.col("span.line_start"), 0),
        F.concat(F.lit("clippy_"), code),
        F.col("m.message.level"),
        _or(F.col("m.message.message"), "Clippy error"),
        "",
        {"code": code, "column": F.col("span.column_start")},
    )
    return _report_rows(placed, "rust", row)


def import_golangci(df: DataFrame) -> DataFrame:
    """golangci-lint JSON: issues about the scanned file, always errors."""
    items = explode_items(df, ["path"], F.from_json("json", GOLANGCI)["Issues"]).filter(
        P.base_name(F.col("item.Pos.Filename")) == P.base_name(F.col("path"))
    )
    linter = _or(F.col("item.FromLinter"), "unknown")
    row = finding(
        _or(F.col("item.Pos.Line"), 0),
        F.concat(F.lit("golangci_"), linter),
        "error",
        _or(F.col("item.Text"), "golangci-lint error"),
        "",
        {"linter": linter, "column": F.col("item.Pos.Column")},
        order=order_key(REPORTS, F.col("pos")),
    )
    return _report_rows(items, "go", row)


def import_mypy(df_text: DataFrame) -> DataFrame:
    """(path, n_issues, note) for files with at least one type error line."""
    lines = F.split(py_strip(F.col("text")), "\n")
    n = F.size(F.filter(lines, lambda line: line.rlike(MYPY_ERROR)))
    counted = df_text.select("path", n.cast("long").alias("n_issues")).filter(F.col("n_issues") > 0)
    note = F.concat(F.lit("Type issues found: "), F.col("n_issues").cast("string"), F.lit(" (review needed)"))
    return counted.withColumn("note", note)


def tool_failures(df_status: DataFrame) -> DataFrame:
    """One error per run of a tool that timed out or was missing; ruff and mypy stay silent."""
    failed = df_status.filter(F.col("status").isin("timeout", "missing") & F.col("tool").isin(list(TOOL_LANGUAGES)))
    table = F.create_map(*[F.lit(x) for pair in TOOL_LANGUAGES.items() for x in pair])
    row = finding(
        0,
        F.concat_ws("_", "tool", "status"),
        "error",
        F.concat(
            F.col("tool"), F.when(F.col("status") == "timeout", " ran out of time").otherwise(" is not installed")
        ),
    )
    return explode_findings(failed.withColumn("language", table[F.col("tool")]), F.array(row))


def import_legacy_log(df_lines: DataFrame) -> DataFrame:
    """'|'-separated log lines: path, line, type and advice are fields 1, 2, 3 and 5.

    Lines with fewer than six fields are dropped.  The separator is not escaped in this
    format, so an escaped one still splits a field.  The format has no language; it is python.
    """
    parts = F.split(py_strip(F.col("line")), r"\|", -1)
    split = df_lines.select(parts.alias("f")).filter(F.size("f") >= 6)

    def plain(i: int) -> Column:
        return F.replace(F.col("f")[i], F.lit("\\|"), F.lit("|"))

    number = F.when(F.col("f")[2].rlike(r"^\d+$"), F.col("f")[2].try_cast("int"))
    row = finding(
        _or(number, 0), plain(3), "error", plain(3), F.replace(plain(5), F.lit("\\n"), F.lit("\n"))
    )
    named = split.withColumn("path", plain(1))
    return explode_findings(named.withColumn("language", F.lit("python")), F.array(row))
