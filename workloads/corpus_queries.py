"""Queries over code files: routing, gates, lines, text rules, syntax rules, scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.operators import corpus, fact_rules, facts, file_rules, line_rules, reports, rulebook
from lintlake.operators.allow_list import apply_allow_index, apply_allow_list, apply_suppressions
from lintlake.operators.rulebook import LineRule
from lintlake.plans import scan
from lintlake.plans.packs import PackRegistry
from lintlake.session import shared_folder
from lintlake.sources.decisions import decision_json, write_decisions
from lintlake.sources.tree import scan_tree
from workloads import fixtures as fx
from workloads.registry import query

FILES_IN_TASK = 2000  # small files that one task reads
PLACE = ["path", "line_num", "violation_type", "severity"]

BR = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"
FILES = f"files AS ({fx.code_files_sql()})"
ROUTED = FILES + r""", routed AS (SELECT * FROM (SELECT *, CASE regexp_extract(path, '(\.[^./]+)$', 1)
 WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'typescript' WHEN '.rs' THEN 'rust'
 WHEN '.go' THEN 'go' END AS language FROM files) WHERE language IS NOT NULL)"""
LINES = ROUTED + f""", lines AS (SELECT path, language, project, t, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_num
 FROM (SELECT *, regexp_split_to_array(regexp_replace(text, '{BR}$', ''), '{BR}') AS ls FROM routed))"""

# What the syntax rules must find in each template, in the order of the file:
# (t, order, line, type, severity, entity, message, advice, context).
_HTTPX, _RUN_M, _EQUAL = "Switch to httpx for HTTP calls", "Run with -m or use a src layout", "Compare values with ==; keep 'is' for None, True and False"
_WRAP = "Wrap the dependency and test the wrapper, or allow {e} in the project configuration"
EXPECTED_SYNTAX = [
    (1, 104, 2, "banned_import", "error", "requests", "Banned import {e}", _HTTPX, "banned_module=requests;import_name={e};is_test_file=false"),
    (1, 203, 3, "local_directory_import", "warning", "urllib.parse", "Import of {e} may depend on the working directory", _RUN_M, "import_name={e};pattern=local_import"),
    (1, 303, 4, "local_directory_import", "warning", "urllib.request", "Import of {e} may depend on the working directory", _RUN_M, "import_name={e};pattern=local_import"),
    (1, 304, 4, "banned_import", "error", "urllib.request", "Banned import {e}", _HTTPX, "banned_module=urllib;import_name={e};is_test_file=false"),
    (1, 404, 5, "banned_import", "error", "os.path", "Banned import {e}", "Use pathlib for paths", "banned_module=os.path;import_name={e};is_test_file=false"),
    (2, 0, 1, "missing_module_docstring", "warning", "module", "Module has no docstring", "Say at the top what the module does", "file_type=module;pattern=missing_module_docstring"),
    (2, 102, 1, "gil_confusion", "warning", "threading", "Threads do not run Python code in parallel", "Use multiprocessing for computing, asyncio for waiting", "import_name={e};pattern=threading_import"),
    (2, 305, 3, "missing_docstring", "warning", "run_{id}", "Function {e} has no docstring", "Describe arguments, result and exceptions", "function_name={e};is_public=true;pattern=missing_function_docstring"),
    (2, 416, 4, "environment_variable_handling", "warning", "os_environ_direct_access", "os.environ used directly", "Call os.getenv with a default", "pattern={e}"),
    (2, 514, 5, "security_violation", "error", "os.path.join", "File path built from a variable may leave its directory", "Resolve the path and check it against the allowed directories", "method={e};pattern=path_traversal_risk"),
    (2, 615, 5, "path_handling", "warning", "join", "os.path in place of pathlib", "Import Path from pathlib", "method={e};pattern=os_path_usage"),
    (3, 204, 3, "banned_import", "error", "unittest", "Banned import {e}", "Use pytest fixtures; unittest.mock itself may stay in tests", "banned_module=unittest;import_name={e};is_test_file=true"),
    (3, 312, 4, "mock_violation", "error", "svc.load", "Mock of {e}", _WRAP, "mock_target={e};mock_type=decorator;pattern=mock_detection"),
    (3, 512, 7, "mock_violation", "error", "Mock", "Mock of {e}", _WRAP, "mock_target={e};mock_type=constructor;pattern=mock_detection"),
    (3, 812, 10, "mock_violation", "error", "aws.put", "Mock of {e}", _WRAP, "mock_target={e};mock_type=context_manager;pattern=mock_detection"),
    (3, 1013, 11, "debug_pattern", "warning", "print", "print() left in the code", "Use a logger, or rich.print", "function={e};pattern=print_usage"),
    (4, 0, 1, "missing_module_docstring", "warning", "module", "Module has no docstring", "Say at the top what the module does", "file_type=module;pattern=missing_module_docstring"),
    (4, 106, 1, "missing_docstring", "warning", "Status_{id}", "Class {e} has no docstring", "Describe what the class is for", "class_name={e};is_public=true;pattern=missing_class_docstring"),
    (4, 108, 1, "enum_opportunity", "warning", "3", "Class Status_{id} holds 3 text constants", "Make it an enum.Enum", "class_name=Status_{id};constant_count=3;pattern=string_constants_class"),
    (4, 207, 5, "dataclass_opportunity", "warning", "2", "Class P_{id} could be a dataclass", "Declare the attributes with @dataclass", "class_name=P_{id};param_count=2;pattern=manual_init_class"),
    (5, 1, 1, "inadequate_module_docstring", "warning", "{len}", "Module docstring is shorter than 20 characters", "Say more about what the module does", "docstring_length={len};pattern=brief_module_docstring"),
    (5, 209, 4, "match_case_opportunity", "warning", "5", "if/elif chain of 5 conditions", "Use match/case", "condition_count=5;pattern=long_if_elif_chain"),
    (5, 209, 6, "match_case_opportunity", "warning", "4", "if/elif chain of 4 conditions", "Use match/case", "condition_count=4;pattern=long_if_elif_chain"),
    (5, 310, 4, "identity_comparison_gotcha", "error", "1000", "Identity test against the integer 1000", _EQUAL, "pattern=integer_identity_comparison;value=1000"),
    (5, 410, 6, "identity_comparison_gotcha", "error", "a", "Identity test against a string", _EQUAL, "pattern=string_identity_comparison;value=a"),
    (5, 710, 12, "identity_comparison_gotcha", "error", "2.5", "Identity test against a float", _EQUAL, "pattern=float_identity_comparison;value=2.5"),
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(
    f"({t}, {order}, {line}, " + ", ".join(_quote(x.replace("{e}", entity)) for x in (kind, severity, entity, *texts)) + ")"
    for t, order, line, kind, severity, entity, *texts in EXPECTED_SYNTAX
)


def _filled(column: str) -> str:
    return f"replace(replace({column}, '{{id}}', file_id::VARCHAR), '{{len}}', length('Short doc ' || file_id)::VARCHAR) AS {column}"


SYNTAX = ROUTED + f""", expected(t, n, line_num, violation_type, severity, entity, message, fix_suggestion, context) AS (VALUES {_VALUES}),
 syntax AS (SELECT path, 'python' AS language, project, files.t AS t, line_num, violation_type, {_filled('message')}, fix_suggestion, severity,
 NULL::VARCHAR AS function_name, {_filled('context')}, 10000000000 + n AS rule_order, {_filled('entity')}
 FROM files JOIN expected ON files.t = expected.t)"""

# Text rules in SQL, over whole texts: severity, message, advice, context, order and where to look.
_STRIP = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _advice(language: str, name: str) -> str:
    cases = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in rulebook.BANNED_NAMES[language].items())
    return f"CASE {name} {cases} END"


def _in_table(language: str, name: str) -> str:
    return f"{name} IN ({', '.join(map(_quote, rulebook.BANNED_NAMES[language]))})"


_NAMED = {
    "typescript": r"""split_part(regexp_extract(line, '^\s*import\s+.*\s+from\s+[''"]([^''"]+)[''"]', 1), '/', 1)""",
    "rust": r"regexp_extract(line, '^\s*use\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)",
    "go": r"""regexp_extract(line, 'import\s+"([^"]+)"', 1)""",
}


def _banned(language: str, what: str, key: str) -> tuple[str, ...]:
    source = f"(SELECT *, {_NAMED[language]} AS p FROM lines WHERE language = '{language}') WHERE {_in_table(language, 'p')}"
    return "error", f"'Banned {what} ''' || p || ''''", _advice(language, "p"), f"'{key}=' || p", "20000000000 + line_num", source


def _on_lines(language: str, regex: str, severity: str, message: str, fix: str, order: int) -> tuple[str, ...]:
    source = f"lines WHERE language = '{language}' AND regexp_matches(line, '{regex}')"
    return severity, _quote(message), _quote(fix), f"'line_content=' || {_STRIP}", f"{20 + order}000000000 + line_num", source


def _on_file(order: int, message: str, fix: str, context: str, condition: str) -> tuple[str, ...]:
    source = f"(SELECT *, 1 AS line_num FROM routed) WHERE language = 'python' AND {condition}"
    return "warning", _quote(message), _quote(fix), _quote(context), f"{30000000000 + order}", source


_TEXT_PARTS: dict[str, tuple[str, ...]] = {
    "banned_package_import": _banned("typescript", "package", "package"),
    "console_usage": _on_lines(
        "typescript", r"\bconsole\.(log|warn|error|debug|info)\(", "warning", "Console output left in the code", "Send messages through a logging library", 1
    ),
    "banned_crate_usage": _banned("rust", "crate", "crate"),
    "banned_package_usage": _banned("go", "package", "package"),
    "panic_abuse": _on_lines("go", r"\bpanic\s*\(", "error", "panic() used in place of an error value", "Return the error and let the caller decide", 1),
    "error_ignoring": _on_lines("go", r",\s*_\s*:=", "warning", "A returned value, probably an error, is dropped with _", "Name the error and check it", 2),
    "antipattern": (
        "warning", "'Threads speed up waiting, not computing'", "''", rf"'line=' || {_STRIP} || ';pattern=import\s+threading'", "21000000000 + line_num",
        r"lines WHERE language = 'python' AND regexp_matches(line, 'import\s+threading')",
    ),
    "test_naming_convention": (
        "warning", "'Test helper ''' || f || ''' does not follow the test_ naming scheme'",
        "'Name tests test_<what>_<when>, or mark helpers with a leading underscore'", "'function_name=' || f", "20000000000 + line_num",
        r"""(SELECT *, regexp_extract(line, '^def\s+(\w+)\s*\(', 1) AS f, split_part(path, '/', -1) AS b FROM lines
 WHERE language = 'python' AND starts_with(trim(line), 'def '))
 WHERE (contains(b, 'test_') OR ends_with(b, '_test.py') OR contains(path, 'tests/'))
 AND f <> '' AND NOT starts_with(f, '_') AND NOT starts_with(f, 'test_')""",
    ),
    "missing_pathlib": _on_file(
        0, "File handling without pathlib", "Import Path from pathlib", "missing_import=pathlib",
        "(contains(text, 'open(') OR contains(lower(text), 'file')) AND NOT contains(text, 'pathlib')",
    ),
    "old_formatting": _on_file(
        1, "Percent-style formatting", "Use f-strings", "formatting_style=old_percent",
        r"""regexp_matches(text, '["''].*%[sd].*["'']') AND NOT contains(text, 'f"')""",
    ),
    "error_handling": _on_file(
        2, "Broad except without logging", "Log the exception with its context", "pattern=exception_without_logging",
        "contains(text, 'except Exception') AND NOT contains(lower(text), 'log')",
    ),
    "composition_violation": (
        "warning", "'More inheritance than classes call for'", "'Compose objects in place of inheriting'",
        "'class_count=' || c || ';inheritance_count=' || i", "30000000003",
        """(SELECT path, language, 1 AS line_num, count(*) FILTER (starts_with(trim(line), 'class ')) AS c,
 count(*) FILTER (contains(lower(line), ' inheritance ') OR contains(line, 'super()')) AS i
 FROM lines WHERE language = 'python' GROUP BY path, language) WHERE c > 0 AND i > 0.5 * c""",
    ),
}

# All columns of a finding, the context as text; the order is only the same if all rules run.
FOUND = "path, language, line_num, violation_type, message, fix_suggestion, severity, function_name, context"
WHOLE = FOUND + ", rule_order"


def _text_rule(name: str) -> str:
    severity, message, fix, context, order, source = _TEXT_PARTS[name]
    return (
        f"SELECT path, language, line_num, '{name}' AS violation_type, {message} AS message, {fix} AS fix_suggestion, '{severity}' AS severity, "
        f"NULL::VARCHAR AS function_name, {context} AS context, {order} AS rule_order FROM {source}"
    )


TEXT_RULES = {name: _text_rule(name) for name in _TEXT_PARTS}
ALL_TEXT = " UNION ALL ".join(f"({sql})" for sql in TEXT_RULES.values())
SYNTAX_LINES = LINES + SYNTAX[len(ROUTED):]
ALL_FOUND = f"WITH {SYNTAX_LINES}, found AS (SELECT {WHOLE} FROM syntax UNION ALL {ALL_TEXT})"


def whole(findings: DataFrame, *more: str) -> DataFrame:
    """Every column of the findings; the context as sorted text, so that both engines print it alike."""
    entries = F.transform(F.map_entries("language_context"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))
    context = F.array_join(F.array_sort(entries), ";").alias("context")
    plain = [c for c in FOUND.split(", ") if c != "context"]
    return findings.select(*plain, context, *more)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.route_language(fx.code_files(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_lines(_files(spark, sf_dir), "language")


def _facts(spark: SparkSession, sf_dir: str, *rules: fact_rules.FactRule) -> DataFrame:
    """The facts the rules look at; all facts if none is given."""
    return facts.extract_py_facts(_files(spark, sf_dir), fact_rules.needed_facts(list(rules)) if rules else None)


# A and B: files


_TREE = (
    "WITH raw AS (SELECT doc_id, doc_id % 7 AS s, CASE WHEN doc_id % 3 = 0 THEN 'go' ELSE 'py' END AS ext, "
    "CASE doc_id % 7 WHEN 0 THEN 'a' || chr(0) || text WHEN 2 THEN ' ' || chr(10) || chr(9) || chr(10) ELSE text END || chr(10) AS c FROM documents), "
    "bytes AS (SELECT doc_id, s, ext, c, encode(c) AS b FROM raw) "
)


TREE_FILES = "*{.py,.go,.txt}"


def tree_name(path):
    """The name under which ``write_tree`` wrote a file."""
    return F.regexp_extract(path, r"([^/=]+)(?:/part-[^/]*\.txt)?$", 1)


@query(
    "scan_tree",
    _TREE + "SELECT 'f' || doc_id || '.' || ext AS file_name, octet_length(b) AS length, sha256(c) AS digest, CASE ext WHEN 'py' THEN 'python' ELSE 'go' END AS language, "
    "CASE WHEN ext = 'go' THEN 'ok' WHEN s = 0 THEN 'binary' WHEN trim(c, ' ' || chr(9) || chr(10)) = '' THEN 'blank' ELSE 'ok' END AS gate FROM bytes",
)
def _(spark, sf_dir):
    """Documents as one file each below the shared folder, listed, read, digested and gated."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    n = F.col("doc_id")
    text = F.when(n % 7 == 0, F.concat(F.lit("a\0"), "text")).when(n % 7 == 2, F.lit(" \n\t\n")).otherwise(F.col("text"))
    name = F.concat(F.lit("f"), n.cast("string"), F.when(n % 3 == 0, ".go").otherwise(".py"))
    n_files = fx.write_tree(fx.text_table(spark, sf_dir, "documents").select(text.alias("text"), name.alias("name")), root)
    # Spark deals out files as if each had another 4 MB, so 32 to a task.
    tasks = max(spark.sparkContext.defaultParallelism, n_files // FILES_IN_TASK)
    found = scan_tree(spark, root, TREE_FILES).coalesce(tasks).withColumn("path", tree_name("path"))
    gated = corpus.with_gate(corpus.route_language(found).withColumn("digest", F.sha2("content", 256)))
    return gated.select(F.col("path").alias("file_name"), "length", "digest", "language", "gate")


@query(
    "route_language",
    "WITH " + ROUTED + " SELECT path, language FROM routed",
)
def _(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "language")


_MIXED = "CASE WHEN file_id % 2 = 0 THEN regexp_replace(path, '\\.([a-z]+)$', '.') || upper(regexp_extract(path, '\\.([a-z]+)$', 1)) ELSE path END"


def _mixed_case(spark, sf_dir):
    suffix = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    upper = F.concat(F.regexp_replace("path", r"\.([a-z]+)$", "."), F.upper(suffix))
    return fx.code_files(spark, sf_dir).withColumn("path", F.when(F.col("file_id") % 2 == 0, upper).otherwise(F.col("path")))


@query("route_strict_case", f"WITH {ROUTED} SELECT path, language FROM routed WHERE file_id % 2 = 1")
def _(spark, sf_dir):
    return corpus.route_language(_mixed_case(spark, sf_dir)).select("path", "language")


@query("route_any_case", f"WITH {ROUTED} SELECT {_MIXED} AS path, language FROM routed")
def _(spark, sf_dir):
    return corpus.route_language(_mixed_case(spark, sf_dir), strict_case=False).select("path", "language")


_RAW = f"WITH raw AS ({fx.RAW_FILES_SQL})"
_TOO_LARGE = "(s = 3 AND n_chars * 100000 > 10485760)"


def _gate(spark, sf_dir, kind):
    found = corpus.gate(corpus.route_language(fx.raw_files(spark, sf_dir)), corpus.MAX_FILE_BYTES)[1]
    return found.filter(F.col("violation_type") == kind).select(*PLACE)


def _gate_sql(kind: str, condition: str) -> str:
    return f"{_RAW} SELECT path, 0 AS line_num, '{kind}' AS violation_type, 'error' AS severity FROM raw WHERE is_py AND {condition}"


@query("gate_size", _gate_sql("file_too_large", _TOO_LARGE))
def _(spark, sf_dir):
    return _gate(spark, sf_dir, "file_too_large")


@query("gate_binary", _gate_sql("binary_file_error", "s = 0"))
def _(spark, sf_dir):
    return _gate(spark, sf_dir, "binary_file_error")


@query("gate_encoding", _gate_sql("encoding_error", "s = 1"))
def _(spark, sf_dir):
    return _gate(spark, sf_dir, "encoding_error")


@query("gate_passed", f"{_RAW} SELECT path FROM raw WHERE (is_py AND s >= 3) OR (NOT is_py AND s <> 1)")
def _(spark, sf_dir):
    """A file above the limit is reported and still analysed."""
    return corpus.gate(corpus.route_language(fx.raw_files(spark, sf_dir)), corpus.MAX_FILE_BYTES)[0].select("path")


@query("gate_empty", f"{_RAW} SELECT path FROM raw WHERE is_py AND s = 2")
def _(spark, sf_dir):
    marked = corpus.with_gate(corpus.route_language(fx.raw_files(spark, sf_dir)))
    return marked.filter(F.col("gate") == "blank").select("path")


@query(
    "gate_access",
    f"WITH {ROUTED} SELECT path, 0 AS line_num, CASE file_id % 4 WHEN 0 THEN 'file_stat_error' WHEN 1 THEN 'file_access_error' "
    "WHEN 2 THEN 'io_error' ELSE 'file_access_error' END AS violation_type, 'error' AS severity FROM routed "
    "WHERE language = 'python' AND contains(text, 'os')",
)
def _(spark, sf_dir):
    files = fx.code_files(spark, sf_dir)
    states = F.array(*[F.lit(s) for s in ("stat", "denied", "io", "missing")])
    manifest = files.select("path", F.element_at(states, (F.col("file_id") % 4 + 1).cast("int")).alias("status"))
    scanned = files.filter(~F.contains("text", F.lit("os")))
    return corpus.gate_access(manifest, scanned).select(*PLACE)


@query("normalize_newlines", f"WITH {FILES} SELECT path, md5(text) AS digest FROM files")
def _(spark, sf_dir):
    ends = F.array(F.lit("\r\n"), F.lit("\r"), F.lit("\n"))
    windows = F.replace("text", F.lit("\n"), F.element_at(ends, (F.col("file_id") % 3 + 1).cast("int")))
    return fx.code_files(spark, sf_dir).select("path", F.md5(X.normalize_newlines(windows).cast("binary")).alias("digest"))


@query("file_extension", f"WITH {FILES} SELECT path, lower(split_part(path, '.', -1)) AS extension FROM files")
def _(spark, sf_dir):
    return _mixed_case(spark, sf_dir).select(
        F.regexp_replace(F.lower("path"), "", "").alias("path"), P.file_extension(F.col("path")).alias("extension")
    )


@query(
    "count_lines",
    f"WITH {FILES} SELECT path, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines FROM files",
)
def _(spark, sf_dir):
    return corpus.count_lines(fx.code_files(spark, sf_dir))


@query("split_lines", f"WITH {LINES} SELECT path, line_num, line FROM lines")
def _(spark, sf_dir):
    return corpus.split_lines(_files(spark, sf_dir))


@query(
    "grep",
    f"WITH {FILES}, l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_num "
    r"FROM (SELECT path, string_split(text, chr(10)) AS ls FROM files)) SELECT path, line_num, trim(line) AS line FROM l WHERE regexp_matches(line, '\bthe\b.*[.,]')",
)
def _(spark, sf_dir):
    return corpus.grep(fx.code_files(spark, sf_dir), r"\bthe\b.*[.,]")


_NAME = "split_part(path, '/', -1)"


@query(
    "is_test_strict",
    f"WITH {FILES} SELECT path, starts_with(lower({_NAME}), 'test_') OR ends_with(lower({_NAME}), '_test.py') "
    "OR contains(lower(path), '/tests/') OR contains(lower(path), '/test/') AS is_test FROM files",
)
def _(spark, sf_dir):
    return fx.code_files(spark, sf_dir).select("path", P.is_test_strict(F.col("path")).alias("is_test"))


@query("is_test_loose", f"WITH {FILES} SELECT path, contains(path, 'test') AS is_test FROM files")
def _(spark, sf_dir):
    return fx.code_files(spark, sf_dir).select("path", P.is_test_loose(F.col("path")).alias("is_test"))


@query(
    "is_test_naming",
    f"WITH {FILES} SELECT path, contains({_NAME}, 'test_') OR ends_with({_NAME}, '_test.py') OR contains(path, 'tests/') "
    "AS is_test FROM files",
)
def _(spark, sf_dir):
    return fx.code_files(spark, sf_dir).select("path", P.is_test_naming(F.col("path")).alias("is_test"))


# C and D: text rules


def _register_line_rule(name: str, run) -> None:
    sql = f"WITH {LINES} {TEXT_RULES[name]}"
    query(f"rule_{name}", sql)(lambda spark, sf_dir: whole(run(_lines(spark, sf_dir)), "rule_order"))


for _name, _run in {
    "banned_package_import": line_rules.rule_banned_package_import,
    "console_usage": line_rules.rule_console_usage,
    "banned_crate_usage": line_rules.rule_banned_crate_usage,
    "banned_package_usage": line_rules.rule_banned_package_usage,
    "panic_abuse": line_rules.rule_panic_abuse,
    "error_ignoring": line_rules.rule_error_ignoring,
    "antipattern": line_rules.rule_antipattern,
    "test_naming_convention": line_rules.rule_test_naming_convention,
}.items():
    _register_line_rule(_name, _run)


def _register_file_rule(name: str, run) -> None:
    sql = f"WITH {LINES} {TEXT_RULES[name]}"
    query(f"rule_{name}", sql)(lambda spark, sf_dir: whole(run(_files(spark, sf_dir)), "rule_order"))


for _name, _run in {
    "missing_pathlib": file_rules.rule_missing_pathlib,
    "old_formatting": file_rules.rule_old_formatting,
    "error_handling": file_rules.rule_error_handling,
    "composition_violation": file_rules.rule_composition_violation,
}.items():
    _register_file_rule(_name, _run)

_LINE_TYPES = [
    "banned_package_import", "console_usage", "banned_crate_usage", "banned_package_usage", "panic_abuse",
    "error_ignoring", "antipattern", "test_naming_convention",
]


@query("apply_line_rules", f"WITH {LINES} " + " UNION ALL ".join(f"({TEXT_RULES[n]})" for n in _LINE_TYPES))
def _(spark, sf_dir):
    return whole(line_rules.apply_line_rules(_lines(spark, sf_dir)), "rule_order")


@query(
    "banned_name_lookup",
    f"WITH {SYNTAX_LINES} SELECT {FOUND} FROM ("
    + " UNION ALL ".join(f"({TEXT_RULES[n]})" for n in _LINE_TYPES if n.startswith("banned"))
    + f") UNION ALL SELECT {FOUND} FROM syntax WHERE violation_type = 'banned_import'",
)
def _(spark, sf_dir):
    names = rulebook.banned_names(spark)
    found = fact_rules.rule_banned_import(_facts(spark, sf_dir, fact_rules.banned_import), names)
    return whole(found.unionByName(line_rules.banned_name_lookup(_lines(spark, sf_dir), names)))


# A generic pack on any text: licence lines, contact lines, questions.
TEXT_PACK = [
    LineRule("license_line", "text", r"(?i)licen[sc]e", "warning", "Licence text"),
    LineRule("contact_line", "text", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9.-]+\.[a-z]{2,}", "error", "Contact address"),
    LineRule("question_line", "text", r"\?", "warning", "A question"),
]
# Conversations hold none of these, but capitals and long words.
CHAT_PACK = [
    *TEXT_PACK,
    LineRule("opening_capital", "text", r"^[A-Z]", "warning", "A line that opens with a capital"),
    LineRule("long_word", "text", r"[a-z]{10,}", "error", "A long word"),
]
_PACK_SQL = {
    "license_line": ("warning", "(?i)licen[sc]e", "Licence text"),
    "contact_line": ("error", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "Contact address"),
    "question_line": ("warning", r"\?", "A question"),
}
_CHAT_SQL = _PACK_SQL | {
    "opening_capital": ("warning", "^[A-Z]", "A line that opens with a capital"),
    "long_word": ("error", "[a-z]{10,}", "A long word"),
}


def _pack_sql(key: str, text: str, table: str, rules: dict[str, tuple[str, str, str]] = _PACK_SQL) -> str:
    parts = " UNION ALL ".join(
        f"SELECT path, 'text' AS language, line_num, '{name}' AS violation_type, '{message}' AS message, '' AS fix_suggestion, "
        f"'{severity}' AS severity, NULL::VARCHAR AS function_name, 'line_content=' || {_STRIP} AS context FROM l WHERE regexp_matches(line, '{regex}')"
        for name, (severity, regex, message) in rules.items()
    )
    split = f"regexp_split_to_array(regexp_replace({text}, '{BR}$', ''), '{BR}')"
    return (
        f"WITH l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_num "
        f"FROM (SELECT {key} AS path, {split} AS ls FROM {table})) {parts}"
    )


def _text_pack(df: DataFrame, key: F.Column, text: str, rules: list[LineRule] = TEXT_PACK) -> DataFrame:
    files = df.select(key.cast("string").alias("path"), F.lit("text").alias("language"), F.col(text).alias("text"))
    return whole(line_rules.apply_line_rules(corpus.split_lines(files, "language"), rules))


@query("text_pack_documents", _pack_sql("doc_id::VARCHAR", "text", "documents"))
def _(spark, sf_dir):
    return _text_pack(fx.text_table(spark, sf_dir, "documents"), F.col("doc_id"), "text")


@query("text_pack_conversations", _pack_sql("conv_id || '/' || turn", "text", "conversations", _CHAT_SQL))
def _(spark, sf_dir):
    turns = fx.text_table(spark, sf_dir, "conversations")
    return _text_pack(turns, F.concat_ws("/", "conv_id", "turn"), "text", CHAT_PACK)


@query("text_pack_pages", _pack_sql("page_id::VARCHAR", "html", "pages"))
def _(spark, sf_dir):
    return _text_pack(fx.text_table(spark, sf_dir, "pages"), F.col("page_id"), "html")


_STYLES = {
    "f_strings": r"""f["''].*\{.*\}.*["'']""",
    "pathlib_usage": r"from pathlib import Path|Path\(",
    "type_hints": r"def \w+\([^)]*\) -> ",
    "context_managers": r"with open\(",
}


@query(
    "required_pattern_coverage",
    f"WITH {ROUTED} SELECT project, count(*) AS n_files, "
    + ", ".join(
        f"sum(regexp_matches(text, '{regex}')::INT)::BIGINT AS {name}_files, sum(regexp_matches(text, '{regex}')::INT) / count(*) AS {name}_share"
        for name, regex in _STYLES.items()
    )
    + " FROM routed WHERE language = 'python' GROUP BY project",
)
def _(spark, sf_dir):
    return file_rules.required_pattern_coverage(_files(spark, sf_dir), "project")


_CATALOG_SQL = ", ".join(
    f"({', '.join(map(_quote, row))})"
    for row in [
        *[("banned_name", language, name, advice) for language, names in rulebook.BANNED_NAMES.items() for name, advice in names.items()],
        *[("line_rule", rule.language, rule.violation_type, rule.pattern) for rule in rulebook.LINE_RULES],
        *[("required_pattern", "python", name, regex) for name, regex in rulebook.REQUIRED_PATTERNS.items()],
    ]
)


@query(
    "rule_catalog",
    f"{ALL_FOUND}, listed(catalog, language, name, detail) AS (VALUES {_CATALOG_SQL}), "
    "used AS (SELECT 'banned_name' AS catalog, language, regexp_extract(context, '(banned_module|package|crate)=([^;]*)', 2) AS name, count(*) AS n "
    "FROM found WHERE starts_with(violation_type, 'banned_') GROUP BY ALL "
    "UNION ALL SELECT 'line_rule', language, violation_type, count(*) FROM found GROUP BY ALL "
    + " ".join(
        f"UNION ALL SELECT 'required_pattern', 'python', '{name}', count(*) FROM routed WHERE language = 'python' AND regexp_matches(text, '{regex}')"
        for name, regex in _STYLES.items()
    )
    + ") SELECT catalog, language, name, detail, coalesce(n, 0) AS n_uses FROM listed LEFT JOIN used USING (catalog, language, name)",
)
def _(spark, sf_dir):
    """All three catalogues: findings per banned name and line rule, files per style pattern."""
    context = F.col("language_context")
    name = F.coalesce(*[F.try_element_at(context, F.lit(k)) for k in ("banned_module", "package", "crate")])
    files = fx.code_files(spark, sf_dir)
    counts = scan.scan_all(files).groupBy("language", "violation_type", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # One pass: a finding counts for its rule and, if it has one, for its banned name.
    entries = F.array_compact(
        F.array(
            F.struct(F.lit("line_rule").alias("catalog"), F.col("violation_type").alias("name")),
            F.when(F.col("violation_type").startswith("banned_"), F.struct(F.lit("banned_name").alias("catalog"), F.col("name"))),
        )
    )
    per_rule = counts.select("language", "n", F.inline(entries)).groupBy("catalog", "language", "name").agg(F.sum("n").alias("n_uses"))
    coverage = file_rules.required_pattern_coverage(corpus.route_language(files))
    styles = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}_files").alias("n_uses")) for k in rulebook.REQUIRED_PATTERNS])
    used = coverage.select(F.lit("required_pattern").alias("catalog"), F.lit("python").alias("language"), F.inline(styles))
    listed = rulebook.rule_catalog(spark).join(per_rule.unionByName(used), ["catalog", "language", "name"], "left")
    return listed.withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))


# E: syntax facts and rules


@query(
    "extract_py_facts",
    f"WITH {FILES}, n(t, kind, k) AS (VALUES (0,'module',1),(0,'function',1),(1,'module',1),(1,'import',4),(1,'import_from',1),"
    "(2,'module',1),(2,'import',2),(2,'function',1),(2,'attribute',3),(2,'call',1),(4,'attribute',2),(11,'attribute',1),(11,'call',3),"
    "(3,'module',1),(3,'import_from',1),(3,'import',1),(3,'decorator',1),(3,'call',4),(3,'function',2),(3,'with_item',1),"
    "(4,'module',1),(4,'class',2),(4,'function',1),(5,'module',1),(5,'function',1),(5,'if_chain',1),(5,'identity_test',5),"
    "(11,'module',1),(11,'function',2),(11,'class',1)) "
    "SELECT path, kind, k::BIGINT AS n FROM files JOIN n ON files.t = n.t",
)
def _(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def _register_fact_rule(name: str, condition: str, *rules) -> None:
    sql = f"WITH {SYNTAX} SELECT {FOUND if rules else WHOLE} FROM syntax WHERE {condition}"

    def run(spark, sf_dir):
        chosen = rules or fact_rules.FACT_RULES
        found = fact_rules.apply_fact_rules(_facts(spark, sf_dir, *chosen), *chosen)
        return whole(found, *([] if rules else ["rule_order"]))

    query(name, sql)(run)


for _name, _condition, _rules in [
    ("rule_banned_import", "violation_type = 'banned_import'", [fact_rules.banned_import]),
    ("rule_gil_confusion", "violation_type = 'gil_confusion'", [fact_rules.gil_confusion]),
    ("rule_local_directory_import", "violation_type = 'local_directory_import'", [fact_rules.local_directory_import]),
    ("rule_missing_function_docstring", "violation_type = 'missing_docstring' AND t = 2", [fact_rules.missing_function_docstring]),
    ("rule_missing_class_docstring", "violation_type = 'missing_docstring' AND t = 4", [fact_rules.missing_class_docstring]),
    ("rule_missing_module_docstring", "violation_type = 'missing_module_docstring'", [fact_rules.missing_module_docstring]),
    ("rule_inadequate_module_docstring", "violation_type = 'inadequate_module_docstring'", [fact_rules.inadequate_module_docstring]),
    ("rule_dataclass_opportunity", "violation_type = 'dataclass_opportunity'", [fact_rules.dataclass_opportunity]),
    ("rule_enum_opportunity", "violation_type = 'enum_opportunity'", [fact_rules.enum_opportunity]),
    ("rule_match_case_opportunity", "violation_type = 'match_case_opportunity'", [fact_rules.match_case_opportunity]),
    ("rule_identity_comparison_gotcha", "violation_type = 'identity_comparison_gotcha'", [fact_rules.identity_comparison_gotcha]),
    ("rule_path_traversal", "violation_type = 'security_violation'", [fact_rules.path_traversal]),
    ("rule_path_handling", "violation_type = 'path_handling'", [fact_rules.path_handling]),
    ("rule_environment_variable_handling", "violation_type = 'environment_variable_handling'", [fact_rules.environment_variable_handling]),
    ("rule_debug_pattern", "violation_type = 'debug_pattern'", [fact_rules.debug_pattern]),
    ("apply_fact_rules", "true", []),
]:
    _register_fact_rule(_name, _condition, *_rules)


def _register_mock_rule(name: str, mock_type: str, target: str) -> None:
    sql = f"WITH {SYNTAX} SELECT {FOUND} FROM syntax WHERE violation_type = 'mock_violation' AND entity = '{target}'"

    def run(spark, sf_dir):
        found = fact_rules.apply_fact_rules(_facts(spark, sf_dir, fact_rules.mock_violation), fact_rules.mock_violation)
        return whole(found.filter(F.element_at("language_context", "mock_type") == mock_type))

    query(name, sql)(run)


_register_mock_rule("rule_mock_decorator", "decorator", "svc.load")
_register_mock_rule("rule_mock_context_manager", "context_manager", "aws.put")
_register_mock_rule("rule_mock_constructor", "constructor", "Mock")


@query(
    "rule_compile_call",
    "SELECT '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.py' AS path, "
    "(2 + length(text) - length(replace(text, chr(10), '')))::INT AS line_num, 'security_violation' AS violation_type, "
    "'warning' AS severity FROM documents WHERE doc_id % 3 > 0",
)
def _(spark, sf_dir):
    """Documents as comments, then a compile call with 0 to 2 positional arguments more than one."""
    calls = F.array(F.lit("compile(a)"), F.lit("compile(a, 'f')"), F.lit("compile(a, 'f', 'exec')"))
    call = F.element_at(calls, (F.col("doc_id") % 3 + 1).cast("int"))
    files = fx.text_table(spark, sf_dir, "documents").select(
        fx._path(".py").alias("path"),
        F.lit("python").alias("language"),
        F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n"), call, F.lit("\n")).alias("text"),
    )
    found = fact_rules.apply_fact_rules(facts.extract_py_facts(files), fact_rules.compile_call)
    return found.select(*PLACE)


_CALLS = ["x = pickle.loads(d)", "eval(y)", "json.loads(z)", "safe.eval(q)", "yaml.load(a).b.c(d)"]
_CALLED = (
    "SELECT '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.py' AS path, 'python' AS language, "
    "(2 + length(text) - length(replace(text, chr(10), '')))::INT AS line_num, doc_id % 5 AS k, text FROM documents"
)


def _calling_files(spark, sf_dir):
    """Documents as comments, then one of a few calls."""
    call = F.element_at(F.array(*[F.lit(c) for c in _CALLS]), (F.col("doc_id") % len(_CALLS) + 1).cast("int"))
    return fx.text_table(spark, sf_dir, "documents").select(
        fx._path(".py").alias("path"),
        F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n"), call, F.lit("\n")).alias("text"),
    )


UNSAFE_LOAD = fact_rules.FactRule(
    "unsafe_load",
    "error",
    ("call",),
    "fact.name IN ('pickle.loads', 'eval')",
    "concat('Unsafe call of ', fact.name)",
    "'Parse the data'",
    {"function": "fact.name", "arguments": "fact.n_args"},
    roots=("pickle", "eval"),
)


@query(
    "user_fact_rule",
    f"WITH c AS ({_CALLED}), u AS (SELECT *, CASE k WHEN 0 THEN 'pickle.loads' WHEN 1 THEN 'eval' END AS f FROM c WHERE k IN (0, 1)) "
    "SELECT path, language, line_num, 'unsafe_load' AS violation_type, 'Unsafe call of ' || f AS message, 'Parse the data' AS fix_suggestion, "
    "'error' AS severity, NULL::VARCHAR AS function_name, 'arguments=1;function=' || f AS context FROM u",
)
def _(spark, sf_dir):
    """A syntax rule of the caller, on calls that no built-in rule asks about, in the whole scan."""
    registry = PackRegistry()
    registry.register("python", fact_rules=[UNSAFE_LOAD])
    found = registry.scan(_calling_files(spark, sf_dir))
    return whole(found.filter(F.col("violation_type") == "unsafe_load"))


@query(
    "extract_calls",
    f"WITH c AS ({_CALLED}), n(k, kind, name, n_args) AS (VALUES (0, 'call', 'pickle.loads', 1), (0, 'attribute', 'pickle.loads', NULL), "
    "(1, 'call', 'eval', 1), (2, 'call', 'json.loads', 1), (2, 'attribute', 'json.loads', NULL), (3, 'call', 'safe.eval', 1), (3, 'attribute', 'safe.eval', NULL), "
    "(4, 'call', '.b.c', 1), (4, 'attribute', '.b.c', NULL), (4, 'attribute', '.b', NULL), (4, 'call', 'yaml.load', 1), (4, 'attribute', 'yaml.load', NULL)) "
    "SELECT path, kind, line_num AS lineno, name, n_args FROM c JOIN n USING (k)",
)
def _(spark, sf_dir):
    """Calls and attributes by name, whoever they belong to."""
    routed = corpus.route_language(_calling_files(spark, sf_dir))
    found = facts.extract_py_facts(routed, {"call": None, "attribute": None})
    return found.select("path", "kind", "lineno", "name", "n_args")


@query(
    "banned_call_lookup",
    f"WITH c AS ({_CALLED}), u AS (SELECT *, CASE k WHEN 0 THEN 'pickle.loads' WHEN 1 THEN 'eval' WHEN 4 THEN 'yaml.load' END AS f, "
    "CASE k WHEN 0 THEN 'pickle' WHEN 1 THEN 'eval' WHEN 4 THEN 'yaml.load' END AS b FROM c WHERE k IN (0, 1, 4)) "
    "SELECT path, language, line_num, 'banned_call' AS violation_type, 'Banned call ' || f AS message, 'Do without ' || b AS fix_suggestion, "
    "'error' AS severity, NULL::VARCHAR AS function_name, 'banned_name=' || b || ';call=' || f AS context FROM u",
)
def _(spark, sf_dir):
    """Calls against a table of 20,003 names, three of which are called."""
    more = spark.range(20000).select(F.concat(F.lit("lib"), "id", F.lit(".call")).alias("name"), F.col("id").alias("rank"))
    own = spark.createDataFrame([("pickle", -3), ("eval", -2), ("yaml.load", -1)], "name string, rank long")
    names = own.union(more).withColumn("suggestion", F.concat(F.lit("Do without "), "name"))
    calls = facts.extract_py_facts(corpus.route_language(_calling_files(spark, sf_dir)), {"call": None})
    return whole(fact_rules.rule_banned_call(calls, names))


@query(
    "user_file_rule",
    f"WITH {ROUTED} SELECT path, language, 1 AS line_num, 'long_file' AS violation_type, 'A long file' AS message, 'Split the file' AS fix_suggestion, "
    "'error' AS severity, NULL::VARCHAR AS function_name, 'characters=' || length(text) AS context FROM routed "
    "WHERE language = 'go' AND length(text) > 1000",
)
def _(spark, sf_dir):
    """A whole-file rule of the caller on another language than Python."""
    registry = PackRegistry()
    rule = file_rules.FileRule(
        "long_file", "length(text) > 1000", "A long file", "Split the file", {"characters": "length(text)"}, severity="error", language="go"
    )
    registry.register("go", file_rules=[rule])
    found = registry.scan(fx.code_files(spark, sf_dir)).filter(F.col("violation_type") == "long_file")
    return whole(found)


@query(
    "analysis_error",
    "SELECT '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.py' AS path, 0 AS line_num, "
    "'analysis_error' AS violation_type, 'warning' AS severity FROM documents WHERE doc_id % 2 = 1",
)
def _(spark, sf_dir):
    found = scan.scan_all(fx.deep_files(spark, sf_dir))
    return found.filter(F.col("violation_type") == "analysis_error").select(*PLACE)


@query(
    "syntax_error_tolerance",
    f"WITH {LINES}, found AS ({ALL_TEXT}) SELECT {WHOLE} FROM found",
)
def _(spark, sf_dir):
    """An unclosed parenthesis silences the syntax rules of a file and no others."""
    files = fx.code_files(spark, sf_dir)
    cut = files.withColumn("text", F.concat("text", F.when(F.col("path").endswith(".py"), "zzz(\n").otherwise("")))
    return whole(scan.scan_all(cut), "rule_order")


def _project_findings(spark, sf_dir):
    files = fx.code_files(spark, sf_dir).withColumn("project_hash", F.col("project"))
    return scan.scan_all(files, keep=("project_hash",))


def _without(condition: str) -> str:
    return f"{ALL_FOUND} SELECT {WHOLE} FROM found WHERE NOT (violation_type = 'mock_violation' AND ({condition}))"


_TARGET = "regexp_extract(context, 'mock_target=([^;]*)', 1)"


def _project_numbers(spark, sf_dir):
    n = F.col("doc_id") % 5
    numbers = fx.table(spark, sf_dir, "documents").select(n.alias("n")).distinct()
    return numbers.select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("project_hash"), "n")


_ALLOWED = _without(
    f"path[4:5] IN ('p0', 'p2', 'p4') AND ({_TARGET} = 'aws.put' OR (path[4:5] = 'p2' AND {_TARGET} = 'svc.load'))"
)


@query("apply_allow_list", _ALLOWED)
def _(spark, sf_dir):
    """Even projects allow aws.*; project 2 also allows s?c.[kl]oad; all other findings stay."""
    config = _project_numbers(spark, sf_dir).select(
        "project_hash",
        F.when(F.col("n") == 2, F.array(F.lit("aws.*"), F.lit("s?c.[kl]oad")))
        .when(F.col("n") % 2 == 0, F.array(F.lit("aws.*")))
        .otherwise(F.array().cast("array<string>"))
        .alias("allowed_patterns"),
    )
    return whole(apply_allow_list(_project_findings(spark, sf_dir), config), "rule_order")


@query("allow_list_index", _ALLOWED)
def _(spark, sf_dir):
    """The same with 5,000 more globs a project, through the index of literal prefixes."""
    more = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.concat(F.lit("svc"), i.cast("string"), F.lit(".*")))
    own = (
        F.when(F.col("n") == 2, F.array(F.lit("aws.*"), F.lit("s?c.[kl]oad")))
        .when(F.col("n") % 2 == 0, F.array(F.lit("aws.*")))
        .otherwise(F.array().cast("array<string>"))
    )
    config = _project_numbers(spark, sf_dir).select("project_hash", F.concat(more, own).alias("allowed_patterns"))
    return whole(apply_allow_index(_project_findings(spark, sf_dir), config), "rule_order")


def _suppressed(spark, sf_dir, enabled):
    files = fx.code_files(spark, sf_dir).withColumn(
        "text", F.replace("text", F.lit("x = Mock()"), F.lit("x = Mock()  # allow-mock"))
    )
    routed = corpus.route_language(files)
    return whole(apply_suppressions(scan.scan_all(files), corpus.split_lines(routed), enabled), "rule_order")


@query("apply_suppressions", _without(f"{_TARGET} = 'Mock'"))
def _(spark, sf_dir):
    return _suppressed(spark, sf_dir, True)


@query("suppressions_off", f"{ALL_FOUND} SELECT {WHOLE} FROM found")
def _(spark, sf_dir):
    return _suppressed(spark, sf_dir, False)


@query("chain_lengths", f"WITH {FILES} SELECT path, 4 + 2 * i::INT AS lineno, 4 - i::INT AS n_following FROM files, range(5) r(i) WHERE t = 5")
def _(spark, sf_dir):
    chains = facts.extract_py_facts(_files(spark, sf_dir), {"if_chain": None})
    return fact_rules.chain_lengths(chains)


# J, G, N: whole scans


@query("scan_all", f"{ALL_FOUND} SELECT {WHOLE} FROM found")
def _(spark, sf_dir):
    return whole(scan.scan_all(fx.code_files(spark, sf_dir)), "rule_order")


@query("scan_profile", f"{ALL_FOUND} SELECT violation_type, severity, count(*) AS n FROM found GROUP BY ALL")
def _(spark, sf_dir):
    return reports.scan_profile(scan.scan_all(fx.code_files(spark, sf_dir)))


@query("severity_filter", f"{ALL_FOUND} SELECT {WHOLE} FROM found WHERE severity = 'error'")
def _(spark, sf_dir):
    return whole(reports.errors(scan.scan_all(fx.code_files(spark, sf_dir))), "rule_order")


def error_line_sql() -> str:
    return "'• ' || split_part(path, '/', -1) || ':' || line_num || ' - ' || message || CASE WHEN fix_suggestion <> '' THEN chr(10) || '  Fix: ' || fix_suggestion ELSE '' END"


def decisions_sql(found: str, passed: str = "'Quality checks passed - no issues found'") -> str:
    """Whole decisions of the files in ``routed`` from the findings in a table."""
    return (
        f", e AS (SELECT path, count(*) AS n, string_agg({error_line_sql()}, chr(10) ORDER BY rule_order, line_num) AS lines "
        f"FROM {found} WHERE severity = 'error' GROUP BY path), "
        "d AS (SELECT routed.path, routed.language, coalesce(n, 0) AS n_errors, CASE WHEN n > 0 THEN 'block' ELSE 'approve' END AS decision, "
        "CASE WHEN n > 0 THEN 2 ELSE 0 END AS exit_code, "
        f"CASE WHEN n > 0 THEN 'Quality violations found (' || n || ' errors):' || chr(10) || lines ELSE {passed} END AS reason "
        "FROM routed LEFT JOIN e ON routed.path = e.path) "
    )


_DECIDED = ALL_FOUND + decisions_sql("found")
_FIXED = ALL_FOUND + decisions_sql(
    "found",
    "CASE WHEN contains(routed.path, '/src/') THEN 'Quality checks passed with auto-fixes:' || chr(10) || '• Applied formatting' "
    "ELSE 'Quality checks passed - no issues found' END",
)


@query("scan_decisions", f"{_DECIDED} SELECT path, language, decision, exit_code, n_errors, reason FROM d")
def _(spark, sf_dir):
    return scan.scan_decisions(fx.code_files(spark, sf_dir))


def _fixed_files(spark, sf_dir):
    fixes = F.when(F.contains("path", F.lit("/src/")), F.array(F.lit("Applied formatting")))
    return _files(spark, sf_dir).select("path", fixes.alias("fixes"))


@query("decide", f"{_FIXED} SELECT path, decision, exit_code, n_errors, reason FROM d")
def _(spark, sf_dir):
    return reports.decide(scan.scan_all(fx.code_files(spark, sf_dir)), _fixed_files(spark, sf_dir))


@query(
    "decide_pages",
    f"{_FIXED}, p AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY rule_order, line_num) - 1) // 2 AS page, "
    f"{error_line_sql()} AS line, rule_order, line_num FROM found WHERE severity = 'error'), "
    "q AS (SELECT path, page, string_agg(line, chr(10) ORDER BY rule_order, line_num) AS lines FROM p GROUP BY ALL) "
    "SELECT path, decision, exit_code, n_errors, coalesce(page, 0) AS page, CASE WHEN page IS NULL THEN reason "
    "WHEN page = 0 THEN split_part(reason, chr(10), 1) || chr(10) || lines ELSE lines END AS reason FROM d LEFT JOIN q USING (path)",
)
def _(spark, sf_dir):
    """Reasons in pages of two errors."""
    return reports.decide_pages(scan.scan_all(fx.code_files(spark, sf_dir)), _fixed_files(spark, sf_dir), 2)


@query("decision_reasons", f"{_DECIDED}, l AS (SELECT path, unnest(string_split(reason, chr(10))) AS line FROM d) SELECT path, line FROM l")
def _(spark, sf_dir):
    """Every line of every reason, with the advice below the errors, all languages."""
    decided = scan.scan_decisions(fx.code_files(spark, sf_dir))
    return decided.select("path", F.explode(F.split("reason", "\n")).alias("line"))


@query("decision_sink", f"{_DECIDED} SELECT path, decision, reason FROM d")
def _(spark, sf_dir):
    """Decisions written as JSON lines and read back."""
    place = f"{shared_folder(spark)}/decisions-{uuid.uuid4().hex}"
    write_decisions(scan.scan_decisions(fx.code_files(spark, sf_dir)), place)
    return spark.read.schema("path string, decision string, reason string").json(place)


@query("decision_json", f"{_DECIDED} SELECT path, decision, reason FROM d")
def _(spark, sf_dir):
    """The decision document of each file, taken apart again."""
    documents = decision_json(scan.scan_decisions(fx.code_files(spark, sf_dir)))
    fields = F.from_json("json", "decision string, reason string").alias("d")
    return documents.select("path", fields).select("path", "d.*")


@query(
    "format_violation",
    f"{ALL_FOUND} SELECT path, line_num, violation_type, rule_order, '📍 ' || split_part(path, '/', -1) || ':' || line_num || ' - ' || message || "
    "CASE WHEN fix_suggestion <> '' THEN chr(10) || '  💡 Fix: ' || fix_suggestion ELSE '' END AS text FROM found",
)
def _(spark, sf_dir):
    found = reports.format_violation(scan.scan_all(fx.code_files(spark, sf_dir)))
    return found.select("path", "line_num", "violation_type", "rule_order", "text")


@query("language_pack", f"WITH {FILES}, l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_num FROM "
       f"(SELECT path, regexp_split_to_array(regexp_replace(text, '{BR}$', ''), '{BR}') AS ls FROM files WHERE ends_with(path, '.md'))) "
       r"SELECT path, line_num, 'long_word' AS violation_type, 'warning' AS severity FROM l WHERE regexp_matches(line, '[a-z]{12,}')")
def _(spark, sf_dir):
    """A language added by the caller, next to the built-in ones."""
    registry = PackRegistry()
    registry.register("markdown", [".md"], [LineRule("long_word", "markdown", r"[a-z]{12,}", "warning", "A long word")])
    found = registry.scan(fx.code_files(spark, sf_dir))
    return found.filter(F.col("language") == "markdown").select(*PLACE)
