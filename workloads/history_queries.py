"""Queries over history, projects, imported reports, rounds and streams."""

from __future__ import annotations

import hashlib
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import convergence, history, projects, reports
from lintlake.session import shared_folder
from lintlake.sources import config, events, history_store, linters
from lintlake.streaming import streams
from workloads import fixtures as fx
from workloads.corpus_queries import ALL_FOUND, FILES, WHOLE, whole
from workloads.registry import AS_OF, query

H = f"WITH h AS ({fx.HISTORY_SQL})"
RECENT = H + ", r AS (SELECT * FROM h WHERE timestamp > TIMESTAMP '2024-01-24 00:00:00')"
COLUMNS = (
    "project_hash, timestamp, file_path, file_name, line_num, violation_type, message, fix_suggestion, severity, "
    "function_name, language"
)
KEY = "project_hash, file_path, line_num, violation_type, message"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.history_rows(spark, sf_dir)


# A14, A15, H1: writing


@query(
    "upsert_history",
    f"{H} SELECT {COLUMNS} FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    rows = _history(spark, sf_dir)
    stored = rows.filter(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz"))
    batch = rows.filter(F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return history.upsert(stored, batch, "seq").drop("seq")


@query(
    "latest_per_key",
    f"{H} SELECT {KEY}, timestamp, fix_suggestion FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    latest = history.latest_per_key(_history(spark, sf_dir), "seq")
    return latest.select(*KEY.split(", "), "timestamp", "fix_suggestion")


@query("expire_history", f"{H} SELECT {COLUMNS} FROM h WHERE NOT timestamp < TIMESTAMP '2024-01-17 00:00:00'")
def _(spark, sf_dir):
    return history.expire(_history(spark, sf_dir), AS_OF, 14).drop("seq")


def _work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "history_store",
    f"{H} SELECT {COLUMNS} FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    """Three batches, one of them written twice, read back as one row per key."""
    place = _work_folder(spark, "history")
    rows = _history(spark, sf_dir)
    day = F.dayofmonth("timestamp")
    parts = [rows.filter(day <= 10), rows.filter((day > 10) & (day <= 20)), rows.filter(day > 20)]
    for batch_id, part in enumerate([*parts, parts[1]]):
        history_store.append_history(history.latest_per_key(part, "seq"), place, batch_id if batch_id < 3 else 1, "loader")
    return history_store.read_history(spark, place)


@query(
    "history_store_look_back",
    f"{RECENT} SELECT {COLUMNS} FROM r QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    place = _work_folder(spark, "history")
    history_store.append_history(history.latest_per_key(_history(spark, sf_dir), "seq"), place, 0, "loader")
    return history_store.read_history(spark, place, AS_OF - timedelta(days=7))


_LATEST = f"{H} SELECT {COLUMNS} FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1"


@query("history_two_writers", _LATEST)
def _(spark, sf_dir):
    """Two writers, each with a batch 0 of the same days: neither replaces the other's."""
    place = _work_folder(spark, "history")
    rows = _history(spark, sf_dir)
    for writer, part in (("even", rows.filter(F.col("seq") % 2 == 0)), ("odd", rows.filter(F.col("seq") % 2 == 1))):
        history_store.append_history(part, place, 0, writer, ("seq",))
    return history_store.read_history(spark, place)


@query(
    "history_equal_times",
    f"{H} SELECT * REPLACE (TIMESTAMP '2024-01-30 00:00:00' AS timestamp) FROM (SELECT {COLUMNS} FROM h "
    f"QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1)",
)
def _(spark, sf_dir):
    """All findings of one scan have one time; the last one found stays."""
    place = _work_folder(spark, "history")
    rows = _history(spark, sf_dir).withColumn("timestamp", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    history_store.append_history(rows, place, 0, "scan", ("seq",))
    return history_store.read_history(spark, place)


@query(
    "compact_history",
    f"{H} SELECT {COLUMNS} FROM h WHERE NOT timestamp < TIMESTAMP '2024-01-17 00:00:00' "
    f"QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    """Compacted without expired rows; a later batch goes to the compacted log."""
    place, target = _work_folder(spark, "history"), _work_folder(spark, "compacted")
    rows = _history(spark, sf_dir)
    late = F.dayofmonth("timestamp") > 25
    history_store.append_history(rows.filter(~late), place, 0, "loader", ("seq",))
    history_store.compact(spark, place, target, AS_OF, 14)
    history_store.append_history(rows.filter(late), target, 1, "loader", ("seq",))
    return history_store.read_history(spark, target)


# G1 to G8, I1 to I4: questions


@query(
    "top_violations",
    f"{RECENT}, c AS (SELECT project_hash, violation_type, count(*) AS count, max(fix_suggestion) AS fix_suggestion FROM r GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY project_hash ORDER BY count DESC, violation_type)::INT AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, sf_dir):
    return history.top_violations(_history(spark, sf_dir), AS_OF)


@query(
    "repeat_offenders",
    f"{RECENT}, c AS (SELECT project_hash, file_name, count(*) AS violation_count, count(DISTINCT violation_type) AS unique_violations FROM r GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY project_hash ORDER BY violation_count DESC, file_name)::INT AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, sf_dir):
    return history.repeat_offenders(_history(spark, sf_dir), AS_OF)


_ISSUES = (
    "i AS (SELECT project_hash, violation_type, count(*) AS n, max(fix_suggestion) AS fix FROM r GROUP BY project_hash, violation_type "
    "QUALIFY row_number() OVER (PARTITION BY project_hash ORDER BY n DESC, violation_type) <= 5)"
)
_WORST = (
    "w AS (SELECT project_hash, file_name, count(*) AS n FROM r GROUP BY project_hash, file_name "
    "QUALIFY row_number() OVER (PARTITION BY project_hash ORDER BY n DESC, file_name) <= 3)"
)


@query(
    "learning_summary",
    f"{RECENT}, {_ISSUES}, {_WORST}, a AS (SELECT project_hash, string_agg(violation_type || '=' || n || '=' || fix, ';' ORDER BY n DESC, violation_type) AS top_issues FROM i GROUP BY 1), "
    "b AS (SELECT project_hash, string_agg(file_name || '=' || n, ';' ORDER BY n DESC, file_name) AS problem_files FROM w GROUP BY 1) "
    "SELECT project_hash, TIMESTAMP '2024-01-31 00:00:00' AS generated_at, top_issues, problem_files FROM a FULL JOIN b USING (project_hash)",
)
def _(spark, sf_dir):
    """The arrays are shown as text, so that both engines print them alike."""
    summary = history.learning_summary(_history(spark, sf_dir), AS_OF)
    issues = F.transform("top_issues", lambda i: F.concat_ws("=", i["type"], i["count"].cast("string"), i["fix"]))
    files = F.transform("problem_files", lambda f: F.concat_ws("=", f["file"], f["violations"].cast("string")))
    return summary.select(
        "project_hash",
        "generated_at",
        F.array_join(issues, ";").alias("top_issues"),
        F.array_join(files, ";").alias("problem_files"),
    )


@query(
    "project_digest",
    f"{RECENT}, {_ISSUES}, {_WORST}, a AS (SELECT project_hash, string_agg('- **' || violation_type || '** (' || n || 'x): ' || fix, chr(10) ORDER BY n DESC, violation_type) AS issues FROM i GROUP BY 1), "
    "b AS (SELECT project_hash, string_agg('- ' || file_name || ': ' || n || ' violations', chr(10) ORDER BY n DESC, file_name) AS files FROM w GROUP BY 1) "
    "SELECT project_hash, '# MEMORY:' || chr(10) || chr(10) || '## Recent Violation Patterns (Last 7 Days)' || chr(10) || chr(10) || issues || chr(10) || chr(10) || "
    "'## Files Needing Attention' || chr(10) || chr(10) || files || chr(10) AS digest FROM a JOIN b USING (project_hash)",
)
def _(spark, sf_dir):
    return reports.project_digest(history.learning_summary(_history(spark, sf_dir), AS_OF))


@query("total_violations", "SELECT count(*) AS total FROM events")
def _(spark, sf_dir):
    return history.total_violations(_history(spark, sf_dir))


@query("top_types", f"{H} SELECT violation_type, count(*) AS count FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    return history.top_types(_history(spark, sf_dir))


@query("top_files", f"{H} SELECT file_name, count(*) AS count FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf_dir):
    return history.top_files(_history(spark, sf_dir))


@query("recent_violations", f"{RECENT} SELECT {COLUMNS} FROM r ORDER BY timestamp DESC")
def _(spark, sf_dir):
    return history.recent_violations(_history(spark, sf_dir), AS_OF).drop("seq")


@query("recent_violations_project", f"{RECENT} SELECT {COLUMNS} FROM r WHERE project_hash = substr(md5('u3'), 1, 8) ORDER BY timestamp DESC")
def _(spark, sf_dir):
    project = hashlib.md5(b"u3").hexdigest()[:8]
    return history.recent_violations(_history(spark, sf_dir), AS_OF, project=project).drop("seq")


@query("recent_top", f"{RECENT} SELECT {COLUMNS} FROM r ORDER BY timestamp DESC, seq LIMIT 20")
def _(spark, sf_dir):
    return history.recent_top(_history(spark, sf_dir), AS_OF, 7, 20, "seq").drop("seq")


@query("reminders", "SELECT DISTINCT user_id AS run_id, 'Look at ' || event_type AS reminder FROM events")
def _(spark, sf_dir):
    said = fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("Look at "), "event_type").alias("reminder")
    )
    return reports.reminders(said)


# A: events, reports, logs, configuration

_TOOLS = ", ".join(f"('{event}', '{tool}')" for event, tool in fx.EVENT_TOOLS.items())
EVENTS = (
    f"WITH tools(event_type, tool_name) AS (VALUES {_TOOLS}), e AS (SELECT event_id, ts, tool_name, "
    "'/w/p' || (user_id % 5) || '/src/f' || event_id || '.py' || CASE event_id % 4 WHEN 1 THEN 'x' ELSE '' END AS path "
    "FROM events JOIN tools USING (event_type) WHERE event_id % 4 IN (0, 1))"
)


@query("edit_events", f"{EVENTS} SELECT event_id, tool_name, path FROM e")
def _(spark, sf_dir):
    return events.edit_events(fx.edit_events_json(spark, sf_dir), "json", "event_id")


@query("coding_events", f"{EVENTS} SELECT event_id, tool_name, path FROM e WHERE tool_name IN ('Write', 'Edit', 'MultiEdit', 'Task')")
def _(spark, sf_dir):
    return reports.coding_events(events.edit_events(fx.edit_events_json(spark, sf_dir), "json", "event_id"))


_DOC = "SELECT doc_id, text, doc_id % 4 AS k, doc_id % 17 = 0 AS broken FROM documents"


@query(
    "import_ruff",
    f"WITH d AS ({_DOC}), e AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN '/w/p' || (doc_id % 5) || '/tests/f' || doc_id || '_test.py' "
    "ELSE '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.py' END AS path FROM d WHERE NOT broken) "
    "SELECT path, (doc_id % 50 + 1)::INT AS line_num, 'S101' AS violation_type, 'assert used' AS message, "
    "CASE WHEN doc_id % 2 = 1 THEN 'Configure per-file-ignores for tests in pyproject.toml: S101 (assert statements, normal in tests)' ELSE '' END AS fix_suggestion, "
    "doc_id % 2 = 1 AS is_test_override, 'error' AS severity FROM e WHERE k >= 1 "
    "UNION ALL SELECT path, 2, 'F401', text, 'Remove the import', false, 'error' FROM e WHERE k >= 2 AND NOT contains(text, 'SyntaxError')",
)
def _(spark, sf_dir):
    found = linters.import_ruff(fx.ruff_reports(spark, sf_dir))
    override = F.element_at("language_context", "is_test_override").cast("boolean")
    return found.select(
        "path", "line_num", "violation_type", "message", "fix_suggestion", override.alias("is_test_override"), "severity"
    )


@query(
    "ruff_test_override",
    "SELECT '/w/p' || (doc_id % 5) || '/tests/f' || doc_id || '_test.py' AS path, 'S101' AS violation_type FROM documents "
    "WHERE doc_id % 2 = 1 AND doc_id % 4 >= 1 AND doc_id % 17 <> 0",
)
def _(spark, sf_dir):
    found = linters.import_ruff(fx.ruff_reports(spark, sf_dir))
    return found.filter(F.element_at("language_context", "is_test_override") == "true").select("path", "violation_type")


@query(
    "import_eslint",
    f"WITH d AS ({_DOC}), e AS (SELECT *, '/w/p' || (doc_id % 5) || '/web/f' || doc_id || '.ts' AS path FROM d WHERE NOT broken) "
    "SELECT path, (doc_id % 40 + 1)::INT AS line_num, 'eslint_no-undef' AS violation_type, text AS message, 'error' AS severity FROM e WHERE k >= 1 "
    "UNION ALL SELECT path, 0, 'eslint_unknown', 'parsing failed', 'error' FROM e WHERE k >= 3",
)
def _(spark, sf_dir):
    found = linters.import_eslint(fx.eslint_reports(spark, sf_dir))
    return found.select("path", "line_num", "violation_type", "message", "severity")


_TSC_LINES = (
    "l AS (SELECT doc_id, '/w/p' || (doc_id % 5) || '/web/f' || doc_id || '.ts' AS path, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS pos "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
)


@query(
    "import_tsc",
    f"WITH {_TSC_LINES} SELECT path, (pos + 1)::INT AS line_num, 'typescript_TS2304' AS violation_type, 'TypeScript: ' || trim(body, ' ') AS message, "
    "CASE WHEN doc_id % 5 IN (0, 3) THEN 'error' ELSE 'warning' END AS severity, (doc_id % 9)::VARCHAR AS col "
    "FROM l WHERE (doc_id + pos) % 2 = 0 AND trim(body) <> ''",
)
def _(spark, sf_dir):
    lines = fx.text_report_lines(spark, sf_dir)
    found = linters.import_tsc(lines, fx.project_markers(spark, sf_dir))
    message = F.concat(F.lit("TypeScript: "), F.trim(F.substr("message", F.lit(13))))
    return found.select(
        "path", "line_num", "violation_type", message.alias("message"), "severity",
        F.element_at("language_context", "column").alias("col"),
    )


@query(
    "import_clippy",
    f"WITH d AS ({_DOC}), e AS (SELECT *, '/w/p' || (doc_id % 5) || '/native/f' || doc_id || '.rs' AS path FROM d WHERE k > 0) "
    "SELECT path, 9 AS line_num, 'clippy_clippy::unwrap_used' AS violation_type, text AS message, 'error' AS severity FROM e "
    "UNION ALL SELECT path, 9, 'clippy_unknown', 'style', 'warning' FROM e WHERE NOT broken",
)
def _(spark, sf_dir):
    found = linters.import_clippy(fx.clippy_lines(spark, sf_dir))
    return found.select("path", "line_num", "violation_type", "message", "severity")


@query(
    "import_golangci",
    f"WITH d AS ({_DOC}), e AS (SELECT *, '/w/p' || (doc_id % 5) || '/cmd/f' || doc_id || '.go' AS path FROM d WHERE NOT broken) "
    "SELECT path, 4 AS line_num, 'golangci_errcheck' AS violation_type, text AS message, 'error' AS severity FROM e WHERE k >= 1 "
    "UNION ALL SELECT path, 6, 'golangci_unknown', 'no linter', 'error' FROM e WHERE k >= 3",
)
def _(spark, sf_dir):
    found = linters.import_golangci(fx.golangci_reports(spark, sf_dir))
    return found.select("path", "line_num", "violation_type", "message", "severity")


@query(
    "malformed_reports",
    "SELECT CASE WHEN doc_id % 17 = 0 THEN 'malformed' ELSE 'readable' END AS state, count(*) AS n_reports, "
    "sum(CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 4 >= 3 THEN 2 WHEN doc_id % 4 >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_findings "
    "FROM documents GROUP BY 1",
)
def _(spark, sf_dir):
    """Reports cut short give no findings; the others give all of theirs."""
    raw = fx.eslint_reports(spark, sf_dir)
    keyed = raw.withColumn("state", F.when(raw.json.startswith("{"), "malformed").otherwise("readable"))
    found = linters.import_eslint(keyed.withColumn("path", F.concat_ws("|", "state", "path")))
    per_state = found.select(
        F.when(F.col("path").startswith("malformed"), "malformed").otherwise("readable").alias("state")
    ).groupBy("state").agg(F.count(F.lit(1)).alias("n_findings"))
    totals = keyed.groupBy("state").agg(F.count(F.lit(1)).alias("n_reports"))
    return totals.join(per_state, "state", "left").select(
        "state", "n_reports", F.coalesce("n_findings", F.lit(0)).alias("n_findings")
    )


@query(
    "import_mypy",
    "WITH d AS (SELECT '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.py' AS path, unnest(string_split(text, chr(10))) AS line FROM documents) "
    "SELECT path, count(*) AS n_issues, 'Type issues found: ' || count(*) || ' (review needed)' AS note FROM d "
    "WHERE regexp_matches(line, '^[A-Z]') GROUP BY path",
)
def _(spark, sf_dir):
    return linters.import_mypy(fx.mypy_reports(spark, sf_dir))


@query(
    "tool_failures",
    "WITH s AS (SELECT '/w/p' || (doc_id % 5) || '/src/f' || doc_id || '.x' AS path, "
    "['eslint', 'tsc', 'clippy', 'golangci', 'ruff', 'mypy', 'eslint'][(doc_id % 7 + 1)::INT] AS tool, "
    "['ok', 'timeout', 'missing'][(doc_id % 3 + 1)::INT] AS status FROM documents) "
    "SELECT path, 0 AS line_num, tool || '_' || status AS violation_type, 'error' AS severity FROM s "
    "WHERE status <> 'ok' AND tool NOT IN ('ruff', 'mypy')",
)
def _(spark, sf_dir):
    return linters.tool_failures(fx.tool_status(spark, sf_dir)).select("path", "line_num", "violation_type", "severity")


@query(
    "import_legacy_log",
    "SELECT '/w/a/f' || event_id || '.py' AS path, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 90 END::INT AS line_num, "
    "event_type AS violation_type, event_type AS message, 'first' || chr(10) || 'second ' || json_extract_string(props, '$.k') AS fix_suggestion, "
    "'error' AS severity FROM events WHERE event_id % 11 <> 0",
)
def _(spark, sf_dir):
    found = linters.import_legacy_log(fx.legacy_log(spark, sf_dir))
    return found.select("path", "line_num", "violation_type", "message", "fix_suggestion", "severity")


_CONFIG = (
    "c AS (SELECT DISTINCT user_id AS u, 'u' || user_id AS project_hash FROM events), cfg AS (SELECT project_hash, "
    "CASE WHEN u % 10 = 3 THEN 3 WHEN u % 4 = 2 THEN (u % 7 + 1) ELSE 3 END::INT AS max_iterations, "
    "CASE WHEN u % 10 <> 3 AND u % 5 = 0 THEN 10 ELSE 30 END::INT AS timeout, "
    "CASE WHEN u % 10 <> 3 AND u % 2 = 0 THEN 'aws.*|svc' || (u % 3) || '.?oad' ELSE '' END AS allowed_patterns FROM c)"
)


@query("project_config", f"WITH {_CONFIG} SELECT * FROM cfg")
def _(spark, sf_dir):
    rows = config.project_config(fx.raw_config(spark, sf_dir))
    return rows.withColumn("allowed_patterns", F.array_join("allowed_patterns", "|"))


# F: projects

PROJECTS = (
    FILES + ", projects AS (SELECT DISTINCT substr(project, 2)::INT AS n FROM files), markers AS (" + fx.MARKERS_SQL + "), "
    "dirs AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS d FROM files), "
    "classes AS (SELECT *, CASE marker WHEN '.git' THEN 1 WHEN 'CLAUDE.md' THEN 3 ELSE 2 END AS priority FROM markers WHERE marker <> 'tsconfig.json'), "
    "ranked AS (SELECT path, d, dir, row_number() OVER (PARTITION BY path ORDER BY priority, length(dir) DESC) AS rn "
    "FROM dirs JOIN classes ON d = dir OR starts_with(d, dir || '/')), "
    "rooted AS (SELECT files.path, dir AS root FROM files LEFT JOIN ranked ON files.path = ranked.path AND rn = 1)"
)
_RANK = "CASE marker WHEN '.git' THEN 1 WHEN 'pyproject.toml' THEN 2 WHEN 'package.json' THEN 4 WHEN 'CLAUDE.md' THEN 13 END"


def _projects(spark, sf_dir):
    return projects.attribute_project(fx.code_files(spark, sf_dir).select("path"), fx.project_markers(spark, sf_dir))


@query(
    "attribute_project",
    f"WITH {PROJECTS} SELECT path, root, CASE WHEN root IS NULL THEN 'unknown' ELSE substr(md5(root), 1, 8) END AS project_hash FROM rooted",
)
def _(spark, sf_dir):
    return _projects(spark, sf_dir).select("path", "root", "project_hash")


@query(
    "root_markers",
    f"WITH {PROJECTS} SELECT root, string_agg(marker, '|' ORDER BY {_RANK}) AS markers FROM (SELECT DISTINCT root FROM rooted WHERE root IS NOT NULL) "
    "JOIN markers ON dir = root WHERE marker <> 'tsconfig.json' GROUP BY root",
)
def _(spark, sf_dir):
    found = projects.root_markers(_projects(spark, sf_dir), fx.project_markers(spark, sf_dir))
    return found.select("root", F.array_join("markers", "|").alias("markers"))


_DEVELOPMENT = "EXISTS (SELECT 1 FROM markers WHERE dir = root AND marker IN ('.claude', 'CLAUDE.md', 'pyproject.toml', 'package.json'))"


@query(
    "is_development_project",
    f"WITH {PROJECTS} SELECT path, {_DEVELOPMENT} AS is_development_project, CASE WHEN {_DEVELOPMENT} THEN 'Development project: the full standards apply' "
    "ELSE 'Loose file: the basic standards apply' END AS context_message FROM rooted",
)
def _(spark, sf_dir):
    return _projects(spark, sf_dir).select("path", "is_development_project", "context_message")


@query("development_projects", f"WITH {PROJECTS} SELECT DISTINCT root FROM rooted WHERE {_DEVELOPMENT}")
def _(spark, sf_dir):
    roots = _projects(spark, sf_dir).select("root").distinct()
    return projects.is_development_project(roots, fx.project_markers(spark, sf_dir))


@query(
    "project_type",
    f"WITH {PROJECTS} SELECT DISTINCT root, CASE WHEN EXISTS (SELECT 1 FROM markers WHERE dir = root AND marker = 'pyproject.toml') THEN 'python' "
    "WHEN EXISTS (SELECT 1 FROM markers WHERE dir = root AND marker = 'package.json') THEN 'javascript' ELSE 'unknown' END AS project_type "
    "FROM rooted WHERE root IS NOT NULL",
)
def _(spark, sf_dir):
    return projects.project_type(_projects(spark, sf_dir), fx.project_markers(spark, sf_dir))


@query("nearest_config", f"WITH {PROJECTS} SELECT path, CASE WHEN project IN ('p0', 'p3') THEN '/w/' || project END AS config_dir FROM files")
def _(spark, sf_dir):
    files = fx.code_files(spark, sf_dir).select("path")
    return projects.nearest_config(files, fx.project_markers(spark, sf_dir), "tsconfig.json")


@query(
    "nearest_config_web",
    f"WITH {PROJECTS} SELECT path, CASE WHEN starts_with(d, '/w/' || project || '/web') THEN '/w/' || project || '/web' END AS config_dir FROM dirs",
)
def _(spark, sf_dir):
    files = fx.code_files(spark, sf_dir).select("path")
    return projects.nearest_config(files, fx.project_markers(spark, sf_dir), "package.json")


_DIGEST = (
    "a AS (SELECT project_hash, string_agg('- **' || violation_type || '** (' || n || 'x): ' || fix, chr(10) ORDER BY n DESC, violation_type) AS issues FROM i GROUP BY 1), "
    "b AS (SELECT project_hash, string_agg('- ' || file_name || ': ' || n || ' violations', chr(10) ORDER BY n DESC, file_name) AS files FROM w GROUP BY 1), "
    "digests AS (SELECT project_hash, '# MEMORY:' || chr(10) || chr(10) || '## Recent Violation Patterns (Last 7 Days)' || chr(10) || chr(10) || issues || chr(10) || chr(10) || "
    "'## Files Needing Attention' || chr(10) || chr(10) || files || chr(10) AS digest FROM a JOIN b USING (project_hash))"
)


@query(
    "inject_context",
    f"{EVENTS}, h AS ({fx.HISTORY_SQL}), r AS (SELECT * FROM h WHERE timestamp > TIMESTAMP '2024-01-24 00:00:00'), {_ISSUES}, {_WORST}, {_DIGEST} "
    "SELECT e.event_id, tool_name, path, project_hash, 'approve' AS decision, digest AS reason FROM e JOIN events USING (event_id) "
    "JOIN digests ON project_hash = substr(md5('u' || (user_id % 10)), 1, 8) WHERE tool_name IN ('Write', 'Edit', 'MultiEdit', 'Task')",
)
def _(spark, sf_dir):
    rows = _history(spark, sf_dir)
    digests = reports.project_digest(history.learning_summary(rows, AS_OF))
    parsed = events.edit_events(fx.edit_events_json(spark, sf_dir), "json", "event_id")
    owners = rows.select(F.col("seq").alias("event_id"), "project_hash")
    injected = reports.inject_context(parsed.join(owners, "event_id"), digests)
    return injected.select("event_id", "tool_name", "path", "project_hash", "decision", "reason")


# H: rounds

_ROUNDS = (
    "r AS (SELECT '/w/f' || (event_id % 700) || '.py' AS path, 'u' || (event_id % 7) AS project_hash, (event_id * 7 % 5 + 1)::INT AS round, "
    "sum(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM events GROUP BY ALL)"
)


def _convergence_sql(limit: str, by: str = "path") -> str:
    return (
        f", s AS (SELECT *, {limit} AS lim FROM r), o AS (SELECT *, CASE WHEN n_errors = 0 THEN 'clean' "
        f"WHEN n_errors >= lag(n_errors) OVER (PARTITION BY {by} ORDER BY round) THEN 'stalled' WHEN round >= lim THEN 'exhausted' END AS outcome "
        f"FROM s WHERE round <= lim), f AS (SELECT {by}, min(round) FILTER (outcome IS NOT NULL) AS first, max(round) AS last FROM o GROUP BY {by}) "
        f"SELECT {by}, round AS stop_round, n_errors AS errors_left, coalesce(outcome, 'open') AS outcome FROM o JOIN f USING ({by}) "
        "WHERE o.round = coalesce(f.first, f.last)"
    )


@query("fix_convergence", f"WITH {_ROUNDS}" + _convergence_sql("3"))
def _(spark, sf_dir):
    return convergence.fix_convergence(fx.scan_rounds(spark, sf_dir).drop("project_hash"))


@query(
    "fix_convergence_config",
    f"WITH {_ROUNDS}, {_CONFIG}"
    + _convergence_sql("coalesce((SELECT max_iterations FROM cfg WHERE cfg.project_hash = r.project_hash), 3)", "project_hash, path"),
)
def _(spark, sf_dir):
    limits = config.project_config(fx.raw_config(spark, sf_dir))
    return convergence.fix_convergence(fx.scan_rounds(spark, sf_dir), limits)


def _shared_paths(df: DataFrame) -> DataFrame:
    """Rounds of fifty paths that seven projects have in common."""
    e = F.col("event_id")
    return df.select(
        F.concat(F.lit("/w/f"), (e % 50).cast("string"), F.lit(".py")).alias("path"),
        F.concat(F.lit("u"), (e % 7).cast("string")).alias("project_hash"),
        (e * 7 % 5 + e % 3 + 1).cast("int").alias("round"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).cast("long").alias("n_errors"),
        "event_id",
    )


_SHARED = (
    "p AS (SELECT '/w/f' || (event_id % 50) || '.py' AS path, 'u' || (event_id % 7) AS project_hash, (event_id * 7 % 5 + event_id % 3 + 1)::INT AS round, "
    "CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS e, event_id FROM events)"
)


@query(
    "fix_convergence_projects",
    f"WITH {_SHARED}, r AS (SELECT path, project_hash, round, sum(e)::BIGINT AS n_errors FROM p GROUP BY ALL)"
    + _convergence_sql("3", "project_hash, path"),
)
def _(spark, sf_dir):
    return convergence.fix_convergence(_shared_paths(fx.table(spark, sf_dir, "events")))


@query(
    "final_round",
    "WITH r AS (SELECT '/w/f' || (event_id % 700) || '.py' AS path, event_id, (event_id * 7 % 5 + 1)::INT AS round FROM events) "
    "SELECT * FROM r QUALIFY round = max(round) OVER (PARTITION BY path)",
)
def _(spark, sf_dir):
    e = F.col("event_id")
    found = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("/w/f"), (e % 700).cast("string"), F.lit(".py")).alias("path"),
        "event_id",
        (e * 7 % 5 + 1).cast("int").alias("round"),
    )
    return convergence.final_round(found)


@query(
    "final_round_projects",
    f"WITH {_SHARED} SELECT path, project_hash, round, event_id FROM p WHERE e = 1 "
    "AND round = (SELECT max(round) FROM p q WHERE q.path = p.path AND q.project_hash = p.project_hash)",
)
def _(spark, sf_dir):
    """Findings of the last round that took place, which may be a clean one without any."""
    rounds = _shared_paths(fx.table(spark, sf_dir, "events"))
    found = rounds.filter(F.col("n_errors") > 0).select("path", "project_hash", "round", "event_id")
    return convergence.final_round(found, rounds)


# L: streams


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream over a table, be it one file or a folder of them.

    A pattern may match either; a plain path has to be a folder for a stream, and a filter on names leaves out a folder's files.
    """
    return spark.readStream.schema(fx.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_stream(spark, sf_dir, "events")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spread(_table_stream(spark, sf_dir, "documents"), like=fx.table(spark, sf_dir, "documents"))


def _drain(stream: DataFrame, place: str) -> DataFrame:
    """Runs a stream over everything that is there into a table, and reads the table."""
    writer = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/out")


@query("stream_scan", f"{ALL_FOUND} SELECT {WHOLE} FROM found")
def _(spark, sf_dir):
    files = fx.code_files_of(_document_stream(spark, sf_dir))
    return _drain(whole(streams.stream_scan(files), "rule_order"), _work_folder(spark, "scan"))


@query(
    "stream_upsert",
    f"{H} SELECT {COLUMNS} FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    place = _work_folder(spark, "upsert")
    rows = fx.history_of(_event_stream(spark, sf_dir)).drop("seq")
    streams.stream_upsert(rows, f"{place}/history", f"{place}/state").awaitTermination()
    return history_store.read_history(spark, f"{place}/history")


@query("stream_two_checkpoints", _LATEST)
def _(spark, sf_dir):
    """Two streams with checkpoints of their own write to one log."""
    place = _work_folder(spark, "upsert")
    rows = fx.history_of(_event_stream(spark, sf_dir))
    for name, remainder in (("even", 0), ("odd", 1)):
        part = rows.filter(F.col("seq") % 2 == remainder).drop("seq")
        streams.stream_upsert(part, f"{place}/history", f"{place}/{name}").awaitTermination()
    return history_store.read_history(spark, f"{place}/history")


@query(
    "stream_equal_times",
    f"{H} SELECT * REPLACE (TIMESTAMP '2024-01-30 00:00:00' AS timestamp) FROM (SELECT {COLUMNS} FROM h "
    f"QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1)",
)
def _(spark, sf_dir):
    """All findings of a micro-batch have one time; the last one found stays."""
    place = _work_folder(spark, "upsert")
    rows = fx.history_of(_event_stream(spark, sf_dir)).withColumn("timestamp", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    streams.stream_upsert(rows, f"{place}/history", f"{place}/state", tie_break=("seq",)).awaitTermination()
    return history_store.read_history(spark, f"{place}/history")


@query("dedup_events", "SELECT event_id, event_type FROM events")
def _(spark, sf_dir):
    """Every event twice, kept once."""
    twice = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = streams.dedup_events(twice, "40 days", "event_id")
    return _drain(kept.select("event_id", "event_type"), _work_folder(spark, "dedup"))


@query(
    "trailing_counts",
    f"{H}, d AS (SELECT *, unnest(range(7)) AS k FROM h), w AS (SELECT project_hash, violation_type, "
    "date_trunc('day', timestamp) - to_days(k::INT) AS window_start FROM d) "
    "SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, project_hash, violation_type, count(*) AS n FROM w "
    "WHERE window_start + INTERVAL 7 DAY <= (SELECT max(timestamp) - INTERVAL 1 DAY FROM h) GROUP BY ALL",
)
def _(spark, sf_dir):
    return _drain(streams.trailing_counts(fx.history_of(_event_stream(spark, sf_dir))), _work_folder(spark, "windows"))
