"""Sources and reports: trees, gates, events, linters, logs, configuration, decisions."""

import hashlib
import json
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark import TaskContext

from lintlake.operators import corpus, reports
from lintlake.plans.scan import scan_all, scan_decisions
from lintlake.sources import config, decisions, events, linters
from lintlake.sources.tree import files_table, scan_tree
from workloads import corpus_queries, fixtures
from workloads.fixtures import write_tree
from workloads.registry import QUERIES


def test_tree_and_gates(spark, tmp_path):
    good = b'"""A docstring that is long enough."""\n'
    contents = {
        "ok.py": good, "sub/win.py": good.replace(b"\n", b"\r\n") + b"import threading\r\n", "nul.py": b"a\x00b",
        "latin.py": good + "é".encode("latin-1"), "cut.py": good + b"# " + b"x" * 983 + "é".encode(), "empty.py": b"",
        "latin.go": b"// \xff", "big.py": b"#" * (10 * 1024 * 1024 + 1), "notes.txt": b"import requests", "UP.PY": b"x",
    }
    for name, data in contents.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(data)
    tree = scan_tree(spark, str(tmp_path))
    # Spark does not list files without content, and they can hold no finding.
    names = {r.path.removeprefix(f"{tmp_path}/") for r in tree.select("path").collect()}
    assert names == set(contents) - {"empty.py", "notes.txt", "UP.PY"}
    found = {(r.path.rsplit("/", 1)[1], r.violation_type, r.line_num) for r in scan_all(tree).collect()}
    assert found == {
        ("nul.py", "binary_file_error", 0), ("latin.py", "encoding_error", 0), ("big.py", "missing_module_docstring", 1),
        ("win.py", "antipattern", 2), ("win.py", "gil_confusion", 2),
    }
    ok, refused = corpus.gate(corpus.route_language(tree), corpus.MAX_FILE_BYTES)
    assert {r.path.rsplit("/", 1)[1] for r in ok.collect()} == {"ok.py", "win.py", "cut.py", "big.py"} and refused.count() == 3
    others = spark.createDataFrame([("/gone.py", 5), ("/gone.go", 5), ("/empty.py", 0)], "path string, length long")
    manifest = tree.select("path", "length").unionByName(others)
    lost = corpus.gate_access(manifest, tree).collect()
    assert [(r.path, r.violation_type) for r in lost] == [("/gone.py", "file_access_error")]


def test_tree_reads_no_bytes_unless_asked(spark, tmp_path, plan):
    (tmp_path / "a.py").write_bytes(b"x")
    tree = scan_tree(spark, str(tmp_path)).filter("length > 100").select("path", "length")
    text = plan(tree)
    assert "PushedFilters: [IsNotNull(length), GreaterThan(length,100)]" in text and "content" not in text.split("ReadSchema")[1]


def test_tree_query_makes_few_folders(spark, tmp_path, monkeypatch):
    """Files lie many to a folder and go many to a task; rows with one name stay files of their own, and without text they are a line break."""
    n = 300
    rows = [(i, f"text {i}") for i in range(n)] + [(1, "text 1"), (1, "other"), (2, None), (None, "nameless")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_queries, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(corpus_queries, "FILES_IN_TASK", 20)
    found = QUERIES["scan_tree"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= max(len(rows) // 20, spark.sparkContext.defaultParallelism)
    got = Counter((r.file_name, r.digest, r.language) for r in found.collect())
    expected = Counter()
    for i, text in rows[:-1]:
        content = {0: f"a\0{text}", 2: " \n\t\n"}.get(i % 7, text or "") + "\n"
        expected["f%d.%s" % (i, "py" if i % 3 else "go"), hashlib.sha256(content.encode()).hexdigest(), "python" if i % 3 else "go"] += 1
    assert got == expected
    assert sum(p.is_dir() for p in (tmp_path / "shared").rglob("*")) < n / 4


def test_tree_is_written_alike_in_other_stores(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "x\ny"), ("b.go", None), ("c.py", "\xe9"), (None, "z")], "name string, text string")
    (tmp_path / "store").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tree.link./in", f"file://{tmp_path}/store")
    for root in (f"{tmp_path}/disk", "viewfs://tree/in/files"):
        assert write_tree(files, root) == 4
        found = scan_tree(spark, root, corpus_queries.TREE_FILES).withColumn("path", corpus_queries.tree_name("path"))
        got = sorted((r.path, bytes(r.content)) for r in found.collect() if not r.path.startswith("__"))
        assert got == [("a.py", b"x\ny\n"), ("b.go", b"\n"), ("c.py", "\xe9\n".encode())]


@pytest.mark.parametrize("in_folder", [1, 2, 100])
def test_repeated_task_writes_its_files_once(spark, tmp_path, monkeypatch, in_folder):
    """Two attempts of a task leave the files of one; names that come again get another folder."""
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda _: SimpleNamespace(partitionId=lambda: 3)))
    batch = pa.RecordBatch.from_pydict({"name": ["a.py", "b.py", "a.py"], "content": [b"1", b"2", b"3"]})
    for _ in range(2):
        assert [b.column("n").to_pylist() for b in fixtures._write_folders(str(tmp_path), in_folder)(iter([batch]))] == [[3]]
    seen = [p for p in tmp_path.rglob("*.py") if not p.relative_to(tmp_path).parts[0].startswith("_")]
    assert sorted((p.name, p.read_bytes()) for p in seen) == [("a.py", b"1"), ("a.py", b"3"), ("b.py", b"2")]


def test_files_table(spark, tmp_path):
    spark.createDataFrame([("/a.rs", "use rand;", 1)], "name string, body string, other int").write.parquet(str(tmp_path / "t"))
    found = scan_all(files_table(spark, str(tmp_path / "t"), "name", "body")).collect()
    assert [(r.path, r.violation_type) for r in found] == [("/a.rs", "banned_crate_usage")]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "json string")


def test_edit_events(spark):
    cases = [
        {"tool_name": "Write", "tool_input": {"file_path": "/a.py"}, "file_path": "/b.py"},
        {"tool_name": "Read", "tool_input": {"file_path": ""}, "file_path": "/b.py"},
        {"file_path": "/c.py"},
        {"tool_name": "Edit", "tool_input": {}},
    ]
    found = events.edit_events(lines(spark, *map(json.dumps, cases), "not json", ""))
    assert [(r.tool_name, r.path) for r in found.collect()] == [("Write", "/a.py"), ("Read", "/b.py"), ("", "/c.py")]
    assert [r.path for r in reports.coding_events(found).collect()] == ["/a.py"]


def reports_of(spark, *documents, path="/p/a.py"):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    return spark.createDataFrame([(path, t) for t in texts], "path string, json string")


def test_ruff(spark):
    entry = {"code": "S101", "message": "m", "fix": None, "location": {"row": 3, "column": 1}}
    document = [entry, {"code": "B1", "message": "SyntaxError: x"}, {"message": None}, {**entry, "code": "F1", "fix": {"message": "do"}}]
    found = linters.import_ruff(reports_of(spark, document, "[{", "{}", "")).collect()
    assert [(r.violation_type, r.line_num, r.fix_suggestion) for r in found] == [("S101", 3, ""), ("", 0, ""), ("F1", 3, "do")]
    test = linters.import_ruff(reports_of(spark, document, path="/p/tests/a.py")).collect()
    assert "per-file-ignores" in test[0].fix_suggestion and test[2].fix_suggestion == "do"


def test_eslint(spark):
    document = [
        {"filePath": "/w/x.ts", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 4, "column": 2, "fix": {"range": [1, 2], "text": "t"}}]},
        {"messages": [{"ruleId": None, "severity": 2}, {"ruleId": "w", "severity": 1}]},
    ]
    found = linters.import_eslint(reports_of(spark, document, "oops", path="/run.ts")).collect()
    assert [(r.path, r.violation_type, r.line_num) for r in found] == [("/w/x.ts", "eslint_r", 4), ("/run.ts", "eslint_unknown", 0)]
    assert json.loads(found[0].fix_suggestion) == {"range": [1, 2], "text": "t"}


def test_tsc_severity_follows_configuration(spark):
    out = spark.createDataFrame(
        [(p, line) for p in ("/a/x.ts", "/b/x.ts") for line in ("x.ts(3,5): error TS2304: Cannot find (y).", "x.ts(3,5): warning TS1: z", "done")],
        "path string, line string",
    )
    markers = spark.createDataFrame([("/a", "tsconfig.json")], "dir string, marker string")
    found = linters.import_tsc(out, markers).collect()
    assert sorted((r.path, r.severity, r.violation_type, r.line_num) for r in found) == [
        ("/a/x.ts", "error", "typescript_TS2304", 3), ("/b/x.ts", "warning", "typescript_TS2304", 3),
    ]
    assert {r.severity for r in linters.import_tsc(out).collect()} == {"warning"}


def test_clippy_and_golangci(spark):
    def message(**changes):
        body = {"message": "m", "level": "error", "code": {"code": "clippy::x"}, "spans": [{"file_name": "src/a.rs", "line_start": 7}], **changes}
        return json.dumps({"reason": "compiler-message", "message": body})

    out = [message(), message(code=None, level="warning"), message(level="note"), message(spans=[]), message(spans=[{"file_name": "src/my_a.rs"}]), "{", ""]
    found = linters.import_clippy(spark.createDataFrame([("/w/a.rs", o) for o in out], "path string, line string")).collect()
    assert [(r.violation_type, r.line_num, r.severity) for r in found] == [("clippy_clippy::x", 7, "error"), ("clippy_unknown", 7, "warning")]
    issues = {"Issues": [{"FromLinter": "l", "Text": "t", "Pos": {"Filename": "b/a.go", "Line": 2, "Column": 1}}, {"Text": "u", "Pos": {"Filename": "c.go"}}]}
    found = linters.import_golangci(reports_of(spark, issues, {"Issues": None}, "[", path="/w/a.go")).collect()
    assert [(r.violation_type, r.line_num, r.language_context["column"]) for r in found] == [("golangci_l", 2, "1")]


def test_mypy_counts_error_lines(spark):
    df = spark.createDataFrame([("/a.py", "a.py:1: error: x\na.py:2: note: y\nFound 1 error"), ("/b.py", "Success: no issues")], "path string, text string")
    assert [(r.path, r.n_issues) for r in linters.import_mypy(df).collect()] == [("/a.py", 1)]


def test_tool_failures(spark):
    runs = [(t, s) for t in ("eslint", "tsc", "clippy", "golangci", "ruff", "mypy") for s in ("ok", "timeout", "missing")]
    df = spark.createDataFrame([("/a", t, s) for t, s in runs], "path string, tool string, status string")
    found = {(r.violation_type, r.line_num, r.severity) for r in linters.tool_failures(df).collect()}
    assert found == {(f"{t}_{s}", 0, "error") for t in ("eslint", "tsc", "clippy", "golangci") for s in ("timeout", "missing")}


def test_legacy_log(spark):
    df = spark.createDataFrame(
        [("t|/a.py|12|kind|x|do\\nthis ",), ("t|/a.py|x1|kind|x|f|more",), ("t|/a.py|1|kind|x",), ("",)], "line string"
    )
    found = linters.import_legacy_log(df).collect()
    assert [(r.path, r.line_num, r.message, r.fix_suggestion) for r in found] == [("/a.py", 12, "kind", "do\nthis"), ("/a.py", 0, "kind", "f")]


def test_project_config(spark):
    docs = ['{"auto_fix": {"max_iterations": 5, "timeout": 0}}', '{"auto_fix": {"max_iterations": "7"}}', '{"auto_fix": {"max_iterations": -1, "timeout": 9}}', "{", '{"mock_detection": {"allowed_patterns": ["a.*"]}}']
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "project_hash string, json string")
    rows = config.project_config(df).orderBy("project_hash").collect()
    assert [(r.max_iterations, r.timeout, r.allowed_patterns) for r in rows] == [(5, 30, []), (3, 30, []), (3, 9, []), (3, 30, []), (3, 30, ["a.*"])]


def test_decisions(spark, files, tmp_path):
    source = files(("/w/a.rs", "use rand;\nuse time;\n"), ("/w/b.rs", "use serde;\n"))
    fixes = spark.createDataFrame([("/w/a.rs", ["x"]), ("/w/b.rs", ["Applied formatting", "y"])], "path string, fixes array<string>")
    decided = {r.path: r for r in reports.decide(scan_all(source), fixes).collect()}
    assert decided["/w/a.rs"].exit_code == 2 and decided["/w/b.rs"].exit_code == 0
    lines = decided["/w/a.rs"].reason.split("\n")
    assert lines[0] == "Quality violations found (2 errors):" and lines[1].startswith("• a.rs:1 - ") and lines[2].startswith("  Fix: ")
    assert decided["/w/b.rs"].reason == "Quality checks passed with auto-fixes:\n• Applied formatting\n• y"
    straight = {r.path: (r.decision, r.n_errors) for r in scan_decisions(source).collect()}
    assert straight == {p: (r.decision, r.n_errors) for p, r in decided.items()}
    assert scan_decisions(source).filter("path = '/w/a.rs'").first().reason == decided["/w/a.rs"].reason
    decisions.write_decisions(scan_decisions(source), str(tmp_path / "out"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {w["decision"] for w in written} == {"block", "approve"}


def test_reports(spark, files):
    found = scan_all(files(("/w/a.go", "panic(x)\npanic(y)\n")))
    assert [(r.violation_type, r.n) for r in reports.scan_profile(found).collect()] == [("panic_abuse", 2)]
    assert reports.errors(found).count() == 2
    assert reports.format_violation(found).first().text.startswith("📍 a.go:1 - panic()")
    said = spark.createDataFrame([(1, "r"), (1, "r"), (2, "r")], "run_id int, reminder string")
    assert reports.reminders(said).count() == 2
    empty = spark.createDataFrame([("p", None, None)], "project_hash string, top_issues array<struct<type:string,count:long,fix:string>>, problem_files array<struct<file:string,violations:long>>")
    assert "No violations logged yet." in reports.project_digest(empty).first().digest


def test_package_is_not_needed_on_executors():
    """The parser travels by value: a process without this package can run it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lintlake.operators import facts

    run = "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read())('import os')[1]['name'], 'lintlake' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", run], input=cloudpickle.dumps(facts.facts_of_text), capture_output=True, cwd="/tmp", timeout=60)
    assert done.stdout.split() == [b"os", b"False"], done.stderr


def test_decision_documents_round_trip(spark, tmp_path):
    from lintlake.sources.decisions import write_decisions

    rows = [("/a.py", "block", "line one\nline \"two\""), ("/b.py", "approve", None)]
    place = str(tmp_path / "decisions")
    write_decisions(spark.createDataFrame(rows, "path string, decision string, reason string"), place)
    back = spark.read.schema("path string, decision string, reason string").json(place)
    assert sorted(map(tuple, back.collect())) == rows


def test_shared_folder_is_never_a_machine_of_a_cluster():
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = conf

    from lintlake.session import shared_folder

    key, warehouse = "spark.checkpoint.dir", "spark.sql.warehouse.dir"
    assert shared_folder(Session("yarn", **{key: "hdfs://x/c/", warehouse: "file:/w"})) == "hdfs://x/c"
    assert shared_folder(Session("local[2]", **{warehouse: "file:/w"})) == "file:/w/_lintlake"
    assert shared_folder(Session("yarn", **{warehouse: "s3a://b/w/"})) == "s3a://b/w/_lintlake"
    with pytest.raises(ValueError):
        shared_folder(Session("spark://h:7077", **{warehouse: "file:/w"}))
