"""Queries over scans with reports, rounds on a stream and the chain of an edit event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.operators import convergence
from lintlake.plans import reviews
from lintlake.sources import history_store, linters
from lintlake.streaming import rounds, streams
from workloads import fixtures as fx
from workloads.corpus_queries import ALL_FOUND, WHOLE, decisions_sql, whole
from workloads.history_queries import COLUMNS, KEY, PROJECTS, _convergence_sql, _document_stream, _work_folder
from workloads.registry import query

# Scan with reports

_OWNER = "'/w/p' || (doc_id % 5)"


def _report_sql(path: str, language: str, line: str, kind: str, message: str, fix: str, severity: str, context: str, order: str, table: str) -> str:
    return (
        f"SELECT {path} AS path, '{language}' AS language, {line} AS line_num, {kind} AS violation_type, {message} AS message, {fix} AS fix_suggestion, "
        f"{severity} AS severity, NULL::VARCHAR AS function_name, {context} AS context, {order} AS rule_order FROM {table}"
    )


_PY, _TS, _RS, _GO = (f"{_OWNER} || '/{d}/f' || doc_id || '.{x}'" for d, x in (("src", "py"), ("web", "ts"), ("native", "rs"), ("cmd", "go")))
_TSC = r"^.*\((\d+),(\d+)\):\s+error\s+(TS\d+):\s+(.+)"
_REPORTED = (
    "docs AS (SELECT doc_id, text, doc_id % 4 AS k, doc_id % 17 <> 0 AS good FROM documents), "
    "tsc AS (SELECT doc_id, pos, 'web/a.ts(' || (pos + 1) || ',' || (doc_id % 9) || '): error TS2304: ' || body AS line FROM "
    "(SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) "
    "WHERE (doc_id + pos) % 2 = 0), reported AS ("
    + " UNION ALL ".join(
        [
            _report_sql(_PY, "python", "(doc_id % 50 + 1)::INT", "'S101'", "'assert used'", "''", "'error'", "'is_test_override=false'", "40000000000", "docs WHERE good AND k >= 1 AND doc_id % 2 = 0"),
            _report_sql(_PY, "python", "2", "'F401'", "text", "'Remove the import'", "'error'", "'is_test_override=false'", "40000000001", "docs WHERE good AND k >= 2 AND doc_id % 2 = 0 AND NOT contains(text, 'SyntaxError')"),
            _report_sql(_TS, "typescript", "(doc_id % 40 + 1)::INT", "'eslint_no-undef'", "text", "''", "'error'", "'column=7;rule_id=no-undef'", "-20000000000", "docs WHERE good AND k >= 1"),
            _report_sql(_TS, "typescript", "0", "'eslint_unknown'", "'parsing failed'", "''", "'error'", "'column=7;rule_id=?'", "-19999999998", "docs WHERE good AND k >= 3"),
            _report_sql(
                _TS, "typescript", "(pos + 1)::INT", "'typescript_TS2304'", f"'TypeScript: ' || regexp_extract(line, '{_TSC}', 4)", "''",
                "CASE WHEN doc_id % 5 IN (0, 3) THEN 'error' ELSE 'warning' END", "'column=' || (doc_id % 9) || ';error_code=TS2304'", "-10000000000 + pos + 1", f"tsc WHERE regexp_matches(line, '{_TSC}')",
            ),
            _report_sql(_RS, "rust", "9", "'clippy_clippy::unwrap_used'", "text", "''", "'error'", "'code=clippy::unwrap_used;column=2'", "-19999999991", "docs WHERE k > 0"),
            _report_sql(_RS, "rust", "9", "'clippy_unknown'", "'style'", "''", "'warning'", "'code=unknown;column=2'", "-19999999991", "docs WHERE good AND k > 0"),
            _report_sql(_GO, "go", "4", "'golangci_errcheck'", "text", "''", "'error'", "'column=3;linter=errcheck'", "-20000000000", "docs WHERE good AND k >= 1"),
            _report_sql(_GO, "go", "6", "'golangci_unknown'", "'no linter'", "''", "'error'", "'column=3;linter=unknown'", "-19999999998", "docs WHERE good AND k >= 3"),
        ]
    )
    + f"), review AS (SELECT {WHOLE} FROM found UNION ALL SELECT {WHOLE} FROM reported SEMI JOIN routed USING (path, language))"
)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of five tools on the documents; most are about files that the corpus does not have."""
    found = [
        linters.import_ruff(fx.ruff_reports(spark, sf_dir)),
        linters.import_eslint(fx.eslint_reports(spark, sf_dir)),
        linters.import_tsc(fx.text_report_lines(spark, sf_dir), fx.project_markers(spark, sf_dir)),
        linters.import_clippy(fx.clippy_lines(spark, sf_dir)),
        linters.import_golangci(fx.golangci_reports(spark, sf_dir)),
    ]
    united = found[0]
    for other in found[1:]:
        united = united.unionByName(other)
    return united


@query("scan_with_reports", f"{ALL_FOUND}, {_REPORTED} SELECT {WHOLE} FROM review")
def _(spark, sf_dir):
    return whole(reviews.scan_with_reports(fx.code_files(spark, sf_dir), _reports(spark, sf_dir)), "rule_order")


@query("decide_with_reports", f"{ALL_FOUND}, {_REPORTED}" + decisions_sql("review") + "SELECT path, decision, exit_code, n_errors, reason FROM d")
def _(spark, sf_dir):
    """Whole reasons of own findings and reports together, in one order."""
    return reviews.decide_with_reports(fx.code_files(spark, sf_dir), _reports(spark, sf_dir))


# Rounds on a stream


def _edited_rounds(events: DataFrame) -> DataFrame:
    """(project_hash, path, round, n_errors, ts): up to five rounds, a minute each, of a run per event."""
    e = F.col("event_id")
    rounds_ = F.explode(F.sequence(F.lit(1), (e % 5 + 1).cast("int"))).alias("round")
    return events.select(
        F.concat(F.lit("u"), F.expr("event_id div 50").cast("string")).alias("project_hash"),
        F.concat(F.lit("/w/f"), (e % 50).cast("string"), F.lit(".py")).alias("path"),
        "ts",
        "event_id",
        rounds_,
    ).select(
        "project_hash",
        "path",
        "round",
        F.greatest(F.lit(0), e % 7 - F.col("round") * (e % 3)).cast("long").alias("n_errors"),
        F.expr("timestampadd(MINUTE, round, ts)").alias("ts"),
    )


_RUNS = (
    "x AS (SELECT 'u' || (event_id // 50) AS project_hash, '/w/f' || (event_id % 50) || '.py' AS path, event_id, ts, "
    "unnest(range(1, event_id % 5 + 2))::INT AS round FROM events), "
    "r AS (SELECT project_hash, path, round, greatest(0, event_id % 7 - round * (event_id % 3))::BIGINT AS n_errors, ts + to_minutes(round) AS ts FROM x)"
)


@query(
    "stream_convergence",
    f"WITH {_RUNS}, found AS (" + "SELECT * FROM (WITH r2 AS (SELECT 1)" + _convergence_sql("3", "project_hash, path") + ")), "
    "last AS (SELECT project_hash, path, max(ts) AS last_ts FROM r GROUP BY ALL) SELECT found.* FROM found JOIN last USING (project_hash, path) "
    "WHERE outcome <> 'open' OR last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM r)",
)
def _(spark, sf_dir):
    """Four batches in the order of time, their rows mixed up and all of them twice, with a restart after each."""
    place = _work_folder(spark, "rounds")
    rows = _edited_rounds(fx.table(spark, sf_dir, "events"))
    for first, last in ((1, 8), (9, 15), (16, 22), (23, 31)):
        part = rows.filter(F.dayofmonth("ts").between(first, last))
        part.unionByName(part).orderBy(F.xxhash64("project_hash", "path", "round")).write.mode("append").parquet(f"{place}/in")
        found = rounds.stream_convergence(spark.readStream.schema(rows.schema).parquet(f"{place}/in"))
        writer = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rounds.RESULT).parquet(f"{place}/out")


@query("edited_rounds", f"WITH {_RUNS}" + _convergence_sql("3", "project_hash, path"))
def _(spark, sf_dir):
    """The batch answer about the same rounds."""
    return convergence.fix_convergence(_edited_rounds(fx.table(spark, sf_dir, "events")))


# From an event to history

_EVENT_TOOLS = ["Write", "Read", "Edit", "MultiEdit", "Bash"]


def _document_events(documents: DataFrame) -> DataFrame:
    """(event_id, json): an edit event per document, its source file after two rounds of fixing."""
    files = fx.code_files_of(documents)
    n = F.col("file_id")
    document = F.struct(
        F.element_at(F.array(*[F.lit(t) for t in _EVENT_TOOLS]), (n % 5 + 1).cast("int")).alias("tool_name"),
        F.struct(F.col("path").alias("file_path"), F.array(F.concat(F.lit("import pandas\n"), "text"), "text").alias("rounds")).alias("tool_input"),
        F.date_format(F.expr("timestampadd(MINUTE, file_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')"), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
    )
    return files.select(n.alias("event_id"), F.to_json(document).alias("json"))


_CHAIN = (
    f"{ALL_FOUND}, " + PROJECTS[PROJECTS.index("projects AS") :] + ", "
    "c AS (SELECT CASE WHEN root IS NULL THEN 'unknown' ELSE substr(md5(root), 1, 8) END AS project_hash, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(file_id) AS timestamp, found.path AS file_path, split_part(found.path, '/', -1) AS file_name, "
    "line_num, violation_type, message, fix_suggestion, severity, function_name, found.language AS language, rule_order "
    "FROM found JOIN rooted ON rooted.path = found.path JOIN files ON files.path = found.path WHERE file_id % 5 IN (0, 2, 3) "
    "AND NOT (violation_type = 'mock_violation' AND contains(context, 'mock_target=aws.put') AND coalesce(root, '') = '/w/p0')) "
    f"SELECT {COLUMNS} FROM c QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, rule_order DESC) = 1"
)


@query("stream_event_chain", _CHAIN)
def _(spark, sf_dir):
    """Every event twice; project 0 allows aws.*; the log is read as one row per finding."""
    place = _work_folder(spark, "chain")
    events = _document_events(_document_stream(spark, sf_dir))
    twice = events.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    owner = P.project_hash(F.lit("/w/p0")).alias("project_hash")
    config = lambda: fx.table(spark, sf_dir, "documents").select(owner, F.array(F.lit("aws.*")).alias("allowed_patterns")).distinct()
    streams.event_chain(twice, f"{place}/history", f"{place}/state", lambda: fx.project_markers(spark, sf_dir), config).awaitTermination()
    return history_store.read_history(spark, f"{place}/history")
