"""Code files, history, markers and reports derived by Spark from the given tables.

``documents`` is prose, so each document becomes one source file: a small program chosen by
the document number, followed by the whole document as comment lines.  The comments go
through every splitter, pattern and parser, so the work grows with the text of the tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# (directory, name, suffix, comment mark, program lines); {id} is the document number.
TEMPLATES: list[tuple[str, str, str, str, list[str]]] = [
    (
        "src", "f{id}", ".py", "# ",
        ['"""Numeric helpers for batch {id}."""', "def add_{id}(x: int) -> int:", '    """Return x."""', "    return x"],
    ),
    (
        "src", "f{id}", ".py", "# ",
        [
            '"""Client module number {id} here."""', "import requests", "import urllib.parse",
            "import urllib.request", "from os.path import join", "import pipeline_tool",
        ],
    ),
    (
        "src", "f{id}", ".py", "# ",
        [
            "import threading", "import os", "def run_{id}(p):", "    v = os.environ['A']",
            "    return os.path.join(p, v)",
        ],
    ),
    (
        "tests", "test_f{id}", ".py", "# ",
        [
            '"""Checks for the loader number {id}."""', "from unittest.mock import patch, Mock", "import unittest",
            "@patch('svc.load')", "def test_a_{id}(m):", '    """Doc."""', "    x = Mock()", "def helper_{id}():",
            '    """Doc."""', "    with patch('aws.put'):", "        print(x)",
        ],
    ),
    (
        "src", "f{id}", ".py", "# ",
        [
            "class Status_{id}:", '    A = "a"', '    B = "b"', '    C = "c"', "class P_{id}:", '    """Doc."""',
            "    def __init__(self, a, b):", "        self.a = a", "        self.b = b",
        ],
    ),
    (
        "src", "f{id}", ".py", "# ",
        [
            '"""Short doc {id}"""', "def f_{id}(x):", '    """Doc."""', "    if x is 1000:", "        return 1",
            "    elif x is 'a':", "        return 2", "    elif x is 5:", "        return 3", "    elif x is 1.0:",
            "        return 4", "    elif x is 2.5:", "        return 5", "    return 0",
        ],
    ),
    (
        "web", "f{id}", ".ts", "// ",
        [
            "import moment from 'moment';", "import x from 'lodash/fp';", "const a = require('axios');",
            "console.log(a); console.warn(x);",
        ],
    ),
    ("web", "f{id}", ".js", "// ", ['import b from "axios";', "    console.error(b)"]),
    ("native", "f{id}", ".rs", "// ", ["use time;", "use std::io;", "use rand::Rng;", "    let v = o.unwrap();"]),
    (
        "cmd", "f{id}", ".go", "// ",
        [
            "package main", 'import "io/ioutil"', "import (", '    "github.com/pkg/errors"', ")", "func main() {",
            '    d, _ := ioutil.ReadFile("a")', "    panic (d)", "}",
        ],
    ),
    ("docs", "f{id}", ".md", "", ["import requests"]),
    (
        "src", "f{id}", ".py", "# ",
        [
            '"""Reader for the batch file {id} x."""', "def r_{id}(p):", '    """Doc."""', "    try:",
            "        h = open(p)", "    except Exception:", '        m = "bad %s" % p', "class B_{id}(Base):",
            '    """Doc."""', "    def _go(self):", "        super()._go()",
        ],
    ),
]


def _by_template(values: list[str]) -> Column:
    """The value of the document's template, as a lookup in a literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` over all cores if ``like``, the table it reads, has fewer splits than that.

    A small table in a single row group would keep one core busy.  A table with a split for
    every core, as any large one has, is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if like.rdd.getNumPartitions() < cores else df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on."""
    df = table(spark, sf_dir, name)
    return spread(df, like=df)


def code_files(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    return code_files_of(text_table(spark, sf_dir, "documents"), with_text)


def code_files_of(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(file_id, project, path, text) of a table or stream of documents."""
    number = F.col("doc_id").cast("string")
    program = F.replace(_by_template(["\n".join(t[4]) + "\n" for t in TEMPLATES]), F.lit("{id}"), number)
    mark = _by_template([t[3] for t in TEMPLATES])
    comment = F.concat(mark, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), mark)), F.lit("\n"))
    name = F.replace(_by_template([f"/{t[0]}/{t[1]}{t[2]}" for t in TEMPLATES]), F.lit("{id}"), number)
    project = F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))
    return documents.select(
        F.col("doc_id").alias("file_id"),
        project.alias("project"),
        F.concat(F.lit("/w/"), project, name).alias("path"),
        (F.concat(program, comment) if with_text else program).alias("text"),
    )


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_array(values: list[str]) -> str:
    return f"[{', '.join(map(_sql, values))}][(doc_id % {len(values)} + 1)::INT]"


def code_files_sql() -> str:
    """The same table for DuckDB, as the body of a CTE; also gives t, the template number."""
    program = f"replace({_sql_array([chr(10).join(t[4]) + chr(10) for t in TEMPLATES])}, '{{id}}', doc_id::VARCHAR)"
    mark = _sql_array([t[3] for t in TEMPLATES])
    name = f"replace({_sql_array([f'/{t[0]}/{t[1]}{t[2]}' for t in TEMPLATES])}, '{{id}}', doc_id::VARCHAR)"
    return (
        "SELECT doc_id AS file_id, doc_id % 12 AS t, 'p' || (doc_id % 5) AS project, "
        f"'/w/p' || (doc_id % 5) || {name} AS path, "
        f"{program} || {mark} || replace(text, chr(10), chr(10) || {mark}) || chr(10) AS text FROM documents"
    )


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_of(table(spark, sf_dir, "events"))


def history_of(events: DataFrame) -> DataFrame:
    """History rows with repeated keys, plus seq, the order of writing."""
    user, event = F.col("user_id"), F.col("event_id")
    name = F.concat(F.lit("f"), (event % 20).cast("string"), F.lit(".py"))
    languages = F.array(*[F.lit(x) for x in ("python", "typescript", "rust", "go")])
    return events.select(
        F.substring(F.md5(F.concat(F.lit("u"), (user % 10).cast("string"))), 1, 8).alias("project_hash"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("/w/d"), (event % 3).cast("string"), F.lit("/"), name).alias("file_path"),
        name.alias("file_name"),
        (event % 10).cast("int").alias("line_num"),
        F.col("event_type").alias("violation_type"),
        F.concat(F.lit("m"), (event % 2).cast("string")).alias("message"),
        F.concat(F.lit("fix "), F.get_json_object("props", "$.k")).alias("fix_suggestion"),
        F.when(F.col("event_type").isin("error", "purchase"), "error").otherwise("warning").alias("severity"),
        F.lit(None).cast("string").alias("function_name"),
        F.element_at(languages, (user % 4 + 1).cast("int")).alias("language"),
        event.alias("seq"),
    )


HISTORY_SQL = """SELECT substr(md5('u' || (user_id % 10)), 1, 8) AS project_hash, ts AS timestamp,
 '/w/d' || (event_id % 3) || '/f' || (event_id % 20) || '.py' AS file_path,
 'f' || (event_id % 20) || '.py' AS file_name, (event_id % 10)::INT AS line_num,
 event_type AS violation_type, 'm' || (event_id % 2) AS message,
 'fix ' || json_extract_string(props, '$.k') AS fix_suggestion,
 CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warning' END AS severity,
 NULL::VARCHAR AS function_name,
 ['python', 'typescript', 'rust', 'go'][(user_id % 4 + 1)::INT] AS language, event_id AS seq FROM events"""


def project_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, marker): rows derived from the projects that own files."""
    n = F.regexp_extract("project", r"(\d+)", 1).cast("int")
    projects = code_files(spark, sf_dir).select("project").distinct().withColumn("n", n)
    root = F.concat(F.lit("/w/"), F.col("project"))

    def at(condition: Column, below: str, marker: str) -> Column:
        return F.when(condition, F.struct(F.concat(root, F.lit(below)).alias("dir"), F.lit(marker).alias("marker")))

    i = F.col("n")
    entries = F.array_compact(
        F.array(
            at(i % 2 == 0, "", ".git"),
            at(i.isin(1, 2), "", "pyproject.toml"),
            at(i >= 0, "/web", "package.json"),
            at(i.isin(3, 4), "/src", "CLAUDE.md"),
            at(i.isin(0, 3), "", "tsconfig.json"),
            at(i == 4, "/native", ".git"),
        )
    )
    return projects.select(F.inline(entries))


MARKERS_SQL = """SELECT '/w/p' || n AS dir, '.git' AS marker FROM projects WHERE n % 2 = 0
UNION ALL SELECT '/w/p' || n, 'pyproject.toml' FROM projects WHERE n IN (1, 2)
UNION ALL SELECT '/w/p' || n || '/web', 'package.json' FROM projects
UNION ALL SELECT '/w/p' || n || '/src', 'CLAUDE.md' FROM projects WHERE n IN (3, 4)
UNION ALL SELECT '/w/p' || n, 'tsconfig.json' FROM projects WHERE n IN (0, 3)
UNION ALL SELECT '/w/p' || n || '/native', '.git' FROM projects WHERE n = 4"""


def edit_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, json): the tool by event type; the path in one of three places or nowhere."""
    path = F.concat(F.lit("/w/p"), (F.col("user_id") % 5).cast("string"), F.lit("/src/f"), F.col("event_id").cast("string"), F.lit(".py"))
    tool = F.col("event_type")
    tools = F.create_map(*[F.lit(x) for pair in EVENT_TOOLS.items() for x in pair])
    place = F.col("event_id") % 4
    document = F.to_json(
        F.struct(
            tools[tool].alias("tool_name"),
            F.struct(F.when(place == 0, path).when(place == 1, F.lit("")).alias("file_path")).alias("tool_input"),
            F.when(place.isin(0, 1), F.concat(path, F.lit("x"))).when(place == 2, F.lit("")).alias("file_path"),
        )
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", document.alias("json"))


EVENT_TOOLS = {"click": "Write", "view": "Read", "error": "Edit", "purchase": "MultiEdit", "signup": "Bash"}


# Linter reports: 0 to 3 entries per document; every 17th report is cut short.


def _path(suffix: str, directory: str = "src") -> Column:
    n = F.col("doc_id")
    return F.concat(
        F.lit("/w/p"), (n % 5).cast("string"), F.lit(f"/{directory}/f"), n.cast("string"), F.lit(suffix)
    )


def _broken(json: Column) -> Column:
    return F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("{"), json)).otherwise(json)


def _report(entries: list[Column]) -> Column:
    return F.slice(F.array(*entries), F.lit(1), (F.col("doc_id") % 4).cast("int"))


def ruff_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, json); documents with an odd number are test files; messages carry the text."""

    def entry(code: str, message: Column, fix: str | None, row: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            message.alias("message"),
            F.when(F.lit(fix is not None), F.struct(F.lit(fix).alias("message"))).alias("fix"),
            F.struct(row.cast("int").alias("row"), F.lit(1).alias("column")).alias("location"),
        )

    entries = [
        entry("S101", F.lit("assert used"), None, F.col("doc_id") % 50 + 1),
        entry("F401", F.col("text"), "Remove the import", F.lit(2)),
        entry("E999", F.concat(F.lit("SyntaxError: "), F.col("text")), None, F.lit(3)),
    ]
    path = F.when(F.col("doc_id") % 2 == 1, _path("_test.py", "tests")).otherwise(_path(".py"))
    return text_table(spark, sf_dir, "documents").select(path.alias("path"), _broken(F.to_json(_report(entries))).alias("json"))


def eslint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    def message(rule: str | None, severity: int, text: Column, line: Column) -> Column:
        return F.struct(
            F.lit(rule).cast("string").alias("ruleId"),
            F.lit(severity).alias("severity"),
            text.alias("message"),
            line.cast("int").alias("line"),
            F.lit(7).alias("column"),
        )

    messages = [
        message("no-undef", 2, F.col("text"), F.col("doc_id") % 40 + 1),
        message("semi", 1, F.lit("missing semicolon"), F.lit(2)),
        message(None, 2, F.lit("parsing failed"), F.lit(None)),
    ]
    document = F.array(F.struct(_path(".ts", "web").alias("filePath"), _report(messages).alias("messages")))
    return text_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/w/bulk"), (F.col("doc_id") % 3).cast("string")).alias("path"),
        _broken(F.to_json(document)).alias("json"),
    )


def golangci_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    def issue(linter: str | None, text: Column, file: Column, line: int) -> Column:
        return F.struct(
            F.lit(linter).cast("string").alias("FromLinter"),
            text.alias("Text"),
            F.struct(file.alias("Filename"), F.lit(line).alias("Line"), F.lit(3).alias("Column")).alias("Pos"),
        )

    here = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".go"))
    issues = [
        issue("errcheck", F.col("text"), F.concat(F.lit("cmd/"), here), 4),
        issue("govet", F.lit("elsewhere"), F.lit("cmd/other.go"), 5),
        issue(None, F.lit("no linter"), here, 6),
    ]
    document = F.struct(F.when(F.col("doc_id") % 4 > 0, _report(issues)).alias("Issues"))
    return text_table(spark, sf_dir, "documents").select(
        _path(".go", "cmd").alias("path"), _broken(F.to_json(document)).alias("json")
    )


def clippy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line): three JSON lines per document, of which one may be cut short."""

    def line(reason: str, level: str, code: str | None, text: Column, file: Column) -> Column:
        span = F.struct(file.alias("file_name"), F.lit(9).alias("line_start"), F.lit(2).alias("column_start"))
        body = F.struct(
            text.alias("message"),
            F.lit(level).alias("level"),
            F.when(F.lit(code is not None), F.struct(F.lit(code).cast("string").alias("code"))).alias("code"),
            F.when(F.col("doc_id") % 4 > 0, F.array(span)).otherwise(F.slice(F.array(span), 1, 0)).alias("spans"),
        )
        return F.to_json(F.struct(F.lit(reason).alias("reason"), body.alias("message")))

    here = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".rs"))
    lines = F.array(
        line("compiler-message", "error", "clippy::unwrap_used", F.col("text"), here),
        _broken(line("compiler-message", "warning", None, F.lit("style"), here)),
        line("build-finished", "error", "x", F.lit("done"), here),
        line("compiler-message", "note", "x", F.lit("note"), here),
        line("compiler-message", "error", "x", F.lit("elsewhere"), F.lit("src/lib.rs")),
    )
    return text_table(spark, sf_dir, "documents").select(_path(".rs", "native").alias("path"), F.explode(lines).alias("line"))


def text_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line): every line of a document, some of them dressed up as compiler errors."""
    docs = text_table(spark, sf_dir, "documents").select(
        _path(".ts", "web").alias("path"), F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "body")
    )
    tsc = F.concat(
        F.lit("web/a.ts("), (F.col("pos") + 1).cast("string"), F.lit(","), (F.col("doc_id") % 9).cast("string"),
        F.lit("): error TS2304: "), F.col("body"),
    )
    return docs.select("path", F.when((F.col("doc_id") + F.col("pos")) % 2 == 0, tsc).otherwise(F.col("body")).alias("line"))


def mypy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the document as tool output, each line that starts with a capital an error."""
    text = F.regexp_replace("text", r"(?m)^([A-Z])", "a.py:1: error: $1")
    return text_table(spark, sf_dir, "documents").select(_path(".py").alias("path"), text.alias("text"))


def tool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    tools = F.array(*[F.lit(t) for t in TOOLS])
    states = F.array(*[F.lit(s) for s in STATES])
    return table(spark, sf_dir, "documents").select(
        _path(".x").alias("path"),
        F.element_at(tools, (n % len(TOOLS) + 1).cast("int")).alias("tool"),
        F.element_at(states, (n % len(STATES) + 1).cast("int")).alias("status"),
    )


TOOLS = ["eslint", "tsc", "clippy", "golangci", "ruff", "mypy", "eslint"]
STATES = ["ok", "timeout", "missing"]


def legacy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): one '|'-separated line per event; some are too short, some have no number."""
    n = F.col("event_id")
    number = F.when(n % 5 == 0, F.lit("n/a")).otherwise((n % 90).cast("string"))
    line = F.concat_ws(
        "|", F.col("ts").cast("date").cast("string"), F.concat(F.lit("/w/a/f"), n.cast("string"), F.lit(".py")), number,
        F.col("event_type"), F.lit("old"),
        F.when(n % 11 != 0, F.concat(F.lit("first\\nsecond "), F.get_json_object("props", "$.k"))),
    )
    return table(spark, sf_dir, "events").select(line.alias("line"))


def raw_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_hash, json): one configuration per user, in various states of repair."""
    u = F.col("user_id")
    globs = F.array(F.lit("aws.*"), F.concat(F.lit("svc"), (u % 3).cast("string"), F.lit(".?oad")))
    fix = F.struct(
        F.when(u % 4 == 0, F.lit(0)).when(u % 4 == 1, F.lit(-1)).when(u % 4 == 2, (u % 7 + 1).cast("int")).alias("max_iterations"),
        F.when(u % 5 == 0, F.lit(10)).alias("timeout"),
    )
    mock = F.when(u % 2 == 0, F.struct(globs.alias("allowed_patterns")))
    json = F.to_json(F.struct(fix.alias("auto_fix"), mock.alias("mock_detection")))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("u"), u.cast("string")).alias("project_hash"),
        F.when(u % 10 == 3, F.lit("not json")).otherwise(json).alias("json"),
    )


def scan_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, project_hash, round, n_errors): events as findings of up to five rounds."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("/w/f"), (e % 700).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("u"), (e % 7).cast("string")).alias("project_hash"),
        (e * 7 % 5 + 1).cast("int").alias("round"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).cast("long").alias("n_errors"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, content): documents as bytes in every state the gates know."""
    n = F.col("doc_id")
    body = F.col("text").cast("binary")
    content = (
        F.when(n % 7 == 0, F.concat(F.lit(b"a\x00"), body))
        .when(n % 7 == 1, F.concat(body, F.lit(b"\xff\xfe")))
        .when(n % 7 == 2, F.lit(b" \n\t\n"))
        .otherwise(body)
    )
    length = F.when(n % 7 == 3, F.col("n_chars") * 100000).otherwise(F.length(content)).cast("long")
    path = F.when(n % 3 == 0, _path(".go")).otherwise(_path(".py"))
    return text_table(spark, sf_dir, "documents").select(
        n.alias("file_id"), path.alias("path"), length.alias("length"), content.alias("content")
    )


RAW_FILES_SQL = """SELECT doc_id AS file_id, n_chars, doc_id % 7 AS s,
 '/w/p' || (doc_id % 5) || '/src/f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.go' ELSE '.py' END AS path,
 doc_id % 3 <> 0 AS is_py FROM documents"""


def deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): files whose last line nests deeper than the parser follows, if odd."""
    text = F.concat(
        F.lit("# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")), F.lit("\ny = "), F.expr("repeat('-', CASE WHEN doc_id % 2 = 1 THEN 20000 ELSE 5 END)"), F.lit("1\n")
    )
    return text_table(spark, sf_dir, "documents").select(_path(".py").alias("path"), text.alias("text"))


def _write_folders(root: str, in_folder: int):
    """Writes each row as a file of its own, some to a folder; a task's folders get their place at once, when all are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, names, folder = f"{root}/_{uuid.uuid4().hex}", 0, set(), ""
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if n % in_folder == 0 or name in names:
                    folder, names = f"{own}/{n}", set()
                    os.makedirs(folder)
                with open(f"{folder}/{name}", "xb") as file:
                    file.write(content)
                names.add(name)
                n += 1
        if n:
            place = f"{root}/{TaskContext.get().partitionId()}"
            try:
                os.rename(own, place)
            except OSError:  # another attempt of this task was first; what begins with _ is not listed
                if not os.path.isdir(place):
                    raise
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def write_tree(files: DataFrame, root: str, in_folder: int = 1000) -> int:
    """Writes each row of ``files`` (name, text) as a file below ``root``, the text with a final LF; gives their number.

    Spark's writer can name folders only, so it takes a folder for each file, which is slow on a
    disk of this machine or a mounted one; there, tasks write files themselves, ``in_folder`` to
    a folder.  In other stores a file is ``name=<name>/part-*.txt``.
    """
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        files.select("text", "name").write.partitionBy("name").text(root)
        return files.count()
    folder = system.makeQualified(path).toUri().getPath()
    os.makedirs(folder)
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")
    rows = files.select(F.coalesce("name", F.lit("unnamed")).alias("name"), content.alias("content"))
    return rows.mapInArrow(_write_folders(folder, in_folder), "n long").agg(F.sum("n")).first()[0] or 0
