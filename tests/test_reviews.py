"""Own findings with reports, long reasons, user rules, rounds and events on streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lintlake.operators import convergence, corpus, fact_rules, facts, file_rules, reports
from lintlake.operators.allow_list import apply_allow_index, apply_allow_list
from lintlake.operators.rulebook import LineRule
from lintlake.plans import reviews
from lintlake.plans.packs import PackRegistry
from lintlake.plans.scan import scan_all
from lintlake.sources import history_store, linters
from lintlake.streaming import rounds, streams

DOC = '"""A module with a docstring."""\n'


def report(spark, path, *messages):
    issues = [{"ruleId": m, "severity": 2, "message": m, "line": i + 1, "column": 1} for i, m in enumerate(messages)]
    rows = [("x", json.dumps([{"filePath": path, "messages": issues}]))]
    return linters.import_eslint(spark.createDataFrame(rows, "path string, json string"))


def ordered(found, path):
    return [r.violation_type for r in found.filter(F.col("path") == path).orderBy("rule_order", "line_num").collect()]


def test_reports_stand_where_the_language_wants_them(spark, files):
    table = files(("/a.ts", "import m from 'moment';\nconsole.log(m)\n"), ("/b.py", DOC + "print(1)\n"), ("/c.js", "console.log(1)\n"))
    tsc = linters.import_tsc(spark.createDataFrame([("/a.ts", "a.ts(1,2): error TS1: x"), ("/c.js", "c.js(1,2): error TS1: x")], "path string, line string"))
    ruff = linters.import_ruff(spark.createDataFrame([("/b.py", json.dumps([{"code": "F1", "message": "m", "location": {"row": 1}}]))], "path string, json string"))
    united = report(spark, "/a.ts", "one", "two").unionByName(tsc).unionByName(ruff).unionByName(report(spark, "/gone.ts", "three"))
    found = reviews.scan_with_reports(table, united)
    assert ordered(found, "/a.ts") == ["eslint_one", "eslint_two", "typescript_TS1", "banned_package_import", "console_usage"]
    assert ordered(found, "/b.py") == ["debug_pattern", "F1"]
    assert ordered(found, "/c.js") == ["console_usage"]  # the compiler looks at .ts and .tsx only
    assert found.filter("path = '/gone.ts'").count() == 0


def test_refused_and_blank_files_have_no_reports(spark, files):
    table = files(("/a.py", "x = '\0'\n"), ("/b.py", " \n"), ("/c.ts", " \n"))
    ruff = [(p, json.dumps([{"code": "F1", "message": "m", "location": {"row": 1}}])) for p in ("/a.py", "/b.py")]
    united = linters.import_ruff(spark.createDataFrame(ruff, "path string, json string")).unionByName(report(spark, "/c.ts", "one"))
    found = reviews.scan_with_reports(table, united)
    assert sorted((r.path, r.violation_type) for r in found.collect()) == [("/a.py", "binary_file_error"), ("/c.ts", "eslint_one")]


def test_a_warning_report_does_not_block_and_an_error_does(spark, files):
    table = files(("/a.ts", "let a = 1;\n"), ("/b.ts", "let b = 1;\n"))
    tsc = spark.createDataFrame([("/a.ts", "a.ts(1,2): error TS1: x")], "path string, line string")
    decided = reviews.decide_with_reports(table, linters.import_tsc(tsc).unionByName(report(spark, "/b.ts", "bad")))
    got = {r.path: (r.decision, r.reason) for r in decided.collect()}
    assert got["/a.ts"][0] == "approve"  # no configuration, so the compiler only warns
    assert got["/b.ts"] == ("block", "Quality violations found (1 errors):\n• b.ts:1 - bad")


def test_reports_keep_extra_columns_and_options(spark, files):
    table = files(("/a.go", "package main\n")).withColumn("project_hash", F.lit("p"))
    issues = json.dumps({"Issues": [{"FromLinter": "vet", "Text": "t", "Pos": {"Filename": "a.go", "Line": 1}}]})
    found = reviews.scan_with_reports(
        table,
        linters.import_golangci(spark.createDataFrame([("/a.go", issues)], "path string, json string")),
        keep=("project_hash",),
        rules=[LineRule("package_line", "go", "^package", "warning", "A package")],
    )
    assert [(r.project_hash, r.violation_type) for r in found.orderBy("rule_order").collect()] == [("p", "golangci_vet"), ("p", "package_line")]


def test_pages_of_a_file_with_very_many_errors(spark, files, plan):
    """100,000 errors of one file: every page is bounded, and together they are the whole reason."""
    n = 100_000
    violations = spark.range(n).select(
        F.lit("/hot.py").alias("path"), F.lit("error").alias("severity"), (F.col("id") % 500).cast("int").alias("line_num"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"), F.lit("fix").alias("fix_suggestion"), (F.col("id") * 7).alias("rule_order"),
    )
    table = files(("/hot.py", ""), ("/calm.py", "")).select("path")
    paged = reports.decide_pages(violations, table, 1000)
    sizes = paged.select("path", "page", F.size(F.split("reason", "\n")).alias("lines")).collect()
    assert len(sizes) == 101 and max(r.lines for r in sizes) == 2001
    pages = [r.reason for r in paged.filter("path = '/hot.py'").orderBy("page").collect()]
    whole = reports.decide(violations, table).filter("path = '/hot.py'").first()
    assert "\n".join(pages) == whole.reason and whole.n_errors == n
    assert paged.filter("path = '/calm.py'").first().decision == "approve"


def test_facts_on_demand_are_a_part_of_all(files):
    text = DOC + "import pickle, os\nwith open(a) as f:\n    pickle.loads(f.read())\neval(x)\nos.path.join(a)\nq()()\n@dec(1)\ndef f():\n    'd'\n"
    routed = corpus.route_language(files(("/a.py", text)))
    every = {(r.kind, r.name) for r in facts.extract_py_facts(routed).collect()}
    assert {("call", "pickle.loads"), ("call", "eval"), ("call", "f.read"), ("call", None), ("decorator", "dec"), ("with_item", "open"), ("attribute", "os.path")} <= every
    needed = {"call": frozenset({"os", "eval"}), "attribute": None, "import": None}
    some = {(r.kind, r.name) for r in facts.extract_py_facts(routed, needed).collect()}
    assert some == {(k, n) for k, n in every if k in ("attribute", "import") or (k == "call" and n in ("os.path.join", "eval"))}


def test_needed_facts_follow_the_rules():
    needed = fact_rules.needed_facts()
    assert "os" in needed["call"] and "print" in needed["call"] and needed["import"] is None and needed["attribute"] == {"os"}
    any_call = fact_rules.FactRule("x", "error", ("call",), "true", "'m'")
    assert fact_rules.needed_facts([*fact_rules.FACT_RULES, any_call])["call"] is None
    assert fact_rules.needed_facts([any_call, fact_rules.debug_pattern])["call"] is None
    assert fact_rules.needed_facts([]) == {}


def test_registry_takes_rules_of_all_kinds(files):
    registry = PackRegistry()
    unsafe = fact_rules.FactRule("unsafe", "error", ("call",), "fact.name = 'pickle.loads'", "'no'", roots=("pickle",))
    registry.register("python", fact_rules=[unsafe], file_rules=[file_rules.FileRule("tiny", "length(text) < 80", "m", "f", {})])
    registry.register("rust", file_rules=[file_rules.FileRule("rusty", "true", "m", "f", {"n": "1"}, severity="error", language="rust")])
    found = registry.scan(files(("/a.py", DOC + "pickle.loads(x)\nprint(1)\n"), ("/b.rs", "use rand;\n"))).collect()
    assert sorted((r.violation_type, r.severity) for r in found) == [
        ("banned_crate_usage", "error"), ("debug_pattern", "warning"), ("rusty", "error"), ("tiny", "warning"), ("unsafe", "error"),
    ]
    with pytest.raises(ValueError):
        registry.register("rust", fact_rules=[unsafe])
    with pytest.raises(ValueError):
        registry.register("go", rules=[LineRule("x", "rust", "x", "error", "m")])


def test_scan_without_any_syntax_rule(files):
    assert scan_all(files(("/a.py", "print(1)\n")), fact_rules=[], file_rules=[], rules=[]).count() == 0


def test_allow_index_equals_allow_list(spark):
    rng = random.Random(4)
    targets = ["aws.put", "svc.load", "a", "", "a*b", "[x]", "aws.get.all", "Mock"]
    globs = ["aws.*", "*", "a?b", "[[]x]", "svc.l[a-o]ad", "aws.g*l", "Mock", "", "a*b", "?"]
    rows = [(f"/f{i}", rng.choice(["p", "q", "r", None]), rng.choice(["mock_violation", "other"]), rng.choice([*targets, None]), i) for i in range(200)]
    found = spark.createDataFrame(rows, "path string, project_hash string, violation_type string, t string, rule_order long")
    found = found.withColumn("language_context", F.create_map(F.lit("mock_target"), "t")).drop("t")
    for _ in range(3):
        config = spark.createDataFrame([(p, rng.sample(globs, 3)) for p in ("p", "q")] + [("r", [])], "project_hash string, allowed_patterns array<string>")
        kept = [sorted(r.path for r in run(found, config).collect()) for run in (apply_allow_list, apply_allow_index)]
        assert kept[0] == kept[1]


def test_rounds_of_one_path_in_two_projects(spark):
    rows = [("/a", "p1", 1, 2), ("/a", "p1", 2, 0), ("/a", "p2", 1, 5), ("/a", "p2", 2, 4)]
    found = convergence.fix_convergence(spark.createDataFrame(rows, "path string, project_hash string, round int, n_errors long")).collect()
    assert sorted((r.project_hash, r.path, r.stop_round, r.errors_left, r.outcome) for r in found) == [("p1", "/a", 2, 0, "clean"), ("p2", "/a", 2, 4, "open")]


def test_a_clean_last_round_leaves_nothing(spark):
    found = spark.createDataFrame([("/a", "p", 1, "x"), ("/b", "p", 2, "y"), ("/a", "q", 1, "z")], "path string, project_hash string, round int, m string")
    took_place = spark.createDataFrame([("/a", "p", 1), ("/a", "p", 2), ("/b", "p", 2), ("/a", "q", 1)], "path string, project_hash string, round int")
    assert sorted(r.m for r in convergence.final_round(found, took_place).collect()) == ["y", "z"]
    assert sorted(r.m for r in convergence.final_round(found).collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("seed", range(60))
def test_outcomes_as_rounds_arrive_equal_the_whole(seed):
    """However rounds arrive, an early outcome is the one that all of them give."""
    rng = random.Random(seed)
    n = rng.randrange(1, 6)
    all_rounds = {r: rng.randrange(4) for r in range(1, n + 1) if rng.random() < 0.9} or {1: 1}
    most = rng.randrange(1, 5)
    whole = rounds.outcome_of(all_rounds, most, complete=True)
    order, seen, early = rng.sample(sorted(all_rounds), len(all_rounds)), {}, None
    for r in order:
        seen[r] = all_rounds[r]
        early = early or rounds.outcome_of(seen, most, complete=False)
    assert early is None or early == whole


def test_convergence_on_a_stream_with_late_rounds_and_a_restart(spark, tmp_path):
    schema = "project_hash string, path string, round int, n_errors long, ts timestamp, max_iterations int"
    batches = [
        [("p", "/a", 2, 1, "00:02", None), ("p", "/b", 1, 4, "00:01", None), ("q", "/a", 1, 3, "00:01", 1)],
        [("p", "/a", 1, 3, "00:01", None), ("p", "/a", 1, 3, "00:01", None), ("p", "/b", 2, 4, "00:05", None), ("p", "/c", 1, 2, "00:05", None)],
        [("p", "/a", 3, 0, "00:09", None), ("p", "/late", 1, 1, "02:00", None)],
        [("p", "/c", 1, 0, "03:00", None), ("p", "/end", 1, 1, "05:00", None)],
    ]
    for i, batch in enumerate(batches):
        rows = [(*r[:4], f"2024-01-01 {r[4]}:00", r[5]) for r in batch]
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (1, 3):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            writer = rounds.stream_convergence(stream).writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rounds.RESULT).parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(r) for r in found) == [
        ("p", "/a", 3, 0, "clean"), ("p", "/b", 2, 4, "stalled"), ("p", "/c", 1, 0, "clean"), ("p", "/c", 1, 2, "open"),
        ("p", "/late", 1, 1, "open"), ("q", "/a", 1, 3, "exhausted"),
    ]  # the timer of /end has not run out


def test_reports_about_other_files_go_before_the_shuffle(spark, files):
    table = files(*[(f"/w/f{i}.rs", "use time;\n") for i in range(2000)], ("/w/a.txt", "x"), ("/w/B.RS", "x"))
    reports = spark.range(20000).selectExpr("concat('/w/f', id, '.rs') AS path", "if(id % 10 = 3, 'python', 'rust') AS language", "id")
    odd = [("/w/a.txt", "rust", -1), ("/w/B.RS", "rust", -2), (None, "rust", -3), ("/w/f1.rs", None, -4)]
    reports = reports.union(spark.createDataFrame(odd, "path string, language string, id long"))
    left = {r.id for r in reviews._about_files(reports, table, None).collect()}
    assert {i for i in range(2000) if i % 10 != 3} <= left
    assert len(left) < 1900


def test_many_files_share_a_state_and_keep_their_own_timers(spark, tmp_path, monkeypatch):
    schema = "project_hash string, path string, round int, n_errors long, ts timestamp"
    rows = [(f"p{i % 3}" if i % 7 else None, f"/f{i}", 1, i % 2, f"2024-01-01 00:{i // 6:02}:00") for i in range(300)]
    rows += [("p", "/again", 1, 2, "2024-01-01 00:50:00"), ("p", "/again", 2, 1, "2024-01-01 01:10:00"), ("p", "/end", 1, 1, "2024-01-01 01:15:00")]
    cut, calls = schema.replace("timestamp", "string"), spark.sparkContext.accumulator(0)
    follow = rounds._follow

    def counted(idle_ms):
        run = follow(idle_ms)

        def one(key, frames, state):
            calls.add(1)
            yield from run(key, frames, state)

        return one

    monkeypatch.setattr(rounds, "_follow", counted)
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, cut).withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        found = rounds.stream_convergence(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), buckets=4)
        writer = found.writeStream.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(rounds.RESULT).parquet(f"{tmp_path}/out").collect()
    # The watermark ends at 01:05: what came by 00:34 is closed by its timer.
    late = [(r[0], r[1], 1, 1, "open") for r in rows[:300] if r[3] and int(r[4][14:16]) < 35]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [(r[0], r[1], 1, 0, "clean") for r in rows[:300] if not r[3]] + late))
    assert calls.value <= 16  # 4 buckets, twice with rows and twice with timers


def test_event_chain_scans_the_last_round_once(spark, tmp_path):
    def event(i, tool, path, *texts, **more):
        return (i, json.dumps({"tool_name": tool, "tool_input": {"file_path": path, "rounds": list(texts), **more}, "ts": f"2024-01-0{i + 1}T00:00:00"}))

    rows = [
        event(0, "Edit", "/w/a/x.rs", "use rand;\nuse time;\n", "use time;\n"), event(1, "Read", "/w/a/y.rs", "use rand;\n"),
        (2, json.dumps({"tool_name": "Write", "tool_input": {"file_path": "/w/b/z.rs", "content": "use rand;\n"}, "ts": "2024-01-03T00:00:00"})), (3, "not json"),
        event(4, "Write", "/w/a/w.rs"), event(5, "MultiEdit", "/w/a/x.rs", "use rand;\nuse rand;\n"),
    ]
    spark.createDataFrame(rows + rows, "event_id long, json string").repartition(3).write.parquet(f"{tmp_path}/in")
    asked = []

    def markers():
        asked.append(1)
        return spark.createDataFrame([("/w/a", ".git")], "dir string, marker string")

    stream = spark.readStream.schema("event_id long, json string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.event_chain(stream, f"{tmp_path}/log", f"{tmp_path}/state", markers).awaitTermination()
    found = history_store.read_history(spark, f"{tmp_path}/log").orderBy("timestamp", "line_num").collect()
    assert [(r.file_path, r.line_num, r.message, r.project_hash == "unknown") for r in found] == [
        ("/w/a/x.rs", 1, "Banned crate 'time'", False), ("/w/b/z.rs", 1, "Banned crate 'rand'", True),
        ("/w/a/x.rs", 1, "Banned crate 'rand'", False), ("/w/a/x.rs", 2, "Banned crate 'rand'", False),
    ]
    assert len(asked) >= 2  # once a batch
