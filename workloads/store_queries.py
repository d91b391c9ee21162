"""Queries over things that are kept up: the history's manifest, daily counts, changed files, the line index, report folders."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators import daily, history, text_index
from lintlake.sources import changes, history_manifest, report_folder
from lintlake.sources.history_store import read_history
from workloads import fixtures as fx
from workloads.corpus_queries import ALL_FOUND, FILES, WHOLE, whole
from workloads.history_queries import COLUMNS, H, KEY, _drain, _history, _work_folder
from workloads.registry import AS_OF, query

# History by manifest

_LATEST = f"{H} SELECT {COLUMNS} FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1"


@query(
    "history_manifest",
    f"WITH l AS ({_LATEST}) SELECT 'before' AS reader, {COLUMNS} FROM l UNION ALL SELECT 'during', {COLUMNS} FROM l UNION ALL SELECT 'after', {COLUMNS} FROM l",
)
def _(spark, sf_dir):
    """Readers of the versions before a compaction, while one more batch slips in, and after it all see one history."""
    place = _work_folder(spark, "manifest")
    rows = _history(spark, sf_dir)
    day = F.dayofmonth("timestamp")
    for batch_id, part in enumerate([rows.filter(day <= 10), rows.filter((day > 10) & (day <= 20)), rows.filter(day > 20)]):
        before = history_manifest.append(history.latest_per_key(part, "seq"), place, batch_id, "loader")
    reader = history_manifest.read(spark, place, version=before)
    # The last batch again replaces itself.
    during = history_manifest.append(history.latest_per_key(rows.filter(day > 20), "seq"), place, 2, "loader")
    after = history_manifest.compact(spark, place)
    seen = reader.withColumn("reader", F.lit("before"))
    for name, version in (("during", during), ("after", after)):
        seen = seen.unionByName(history_manifest.read(spark, place, version=version).withColumn("reader", F.lit(name)))
    return seen


@query(
    "history_manifest_expired",
    f"{H} SELECT {COLUMNS} FROM h WHERE timestamp > TIMESTAMP '2024-01-24 00:00:00' "
    f"QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq DESC) = 1",
)
def _(spark, sf_dir):
    """Whole dates are dropped from the manifest; a look-back does not notice."""
    place = _work_folder(spark, "manifest")
    history_manifest.append(history.latest_per_key(_history(spark, sf_dir), "seq"), place, 0, "loader")
    history_manifest.expire_dates(spark, place, AS_OF, 10)
    return history_manifest.read(spark, place, AS_OF - timedelta(days=7))


# Look-backs from daily counts


def _recorded(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The history in three batches that move rows from day to day, one of them recorded twice."""
    place = _work_folder(spark, "daily")
    rows = _history(spark, sf_dir)
    parts = [rows.filter(F.col("seq") % 3 == k) for k in range(3)]
    for batch_id in (0, 1, 1, 2):
        daily.record_batch(parts[batch_id], f"{place}/history", f"{place}/counts", batch_id, "loader", ("seq",))
    return f"{place}/history", f"{place}/counts"


# Of rows with one key and time, the one in the later batch stays.
_CURRENT = (
    f"{H}, l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY timestamp DESC, seq % 3 DESC, seq DESC) = 1), "
    "r AS (SELECT * FROM l WHERE timestamp > TIMESTAMP '2024-01-24 12:00:00')"
)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of seven days from noon on: the first day from the history, the others from the counts."""
    stored, counts = _recorded(spark, sf_dir)
    as_of = AS_OF + timedelta(hours=12)
    start = as_of - timedelta(days=7)
    return daily.look_back_counts(daily.read_counts(spark, counts, start), read_history(spark, stored, start), as_of)


@query(
    "top_violations_incremental",
    f"{_CURRENT}, c AS (SELECT project_hash, violation_type, count(*)::BIGINT AS count, max(fix_suggestion) AS fix_suggestion FROM r GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY project_hash ORDER BY count DESC, violation_type)::INT AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, sf_dir):
    return daily.top_violations_of(_counts(spark, sf_dir))


@query(
    "repeat_offenders_incremental",
    f"{_CURRENT}, c AS (SELECT project_hash, file_name, count(*)::BIGINT AS violation_count, count(DISTINCT violation_type) AS unique_violations FROM r GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY project_hash ORDER BY violation_count DESC, file_name)::INT AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, sf_dir):
    return daily.repeat_offenders_of(_counts(spark, sf_dir))


# Changed files


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus twice: a third of the files edited, some gone and some new."""
    files = fx.code_files(spark, sf_dir)
    n = F.col("file_id")
    edited = F.when(n % 3 == 0, F.replace("text", F.lit("import requests"), F.lit("import numpy"))).otherwise(F.col("text"))
    later = files.filter(n % 7 != 0).withColumn("text", F.when(n % 3 == 0, F.concat(edited, F.lit("\n"))).otherwise(edited))
    return files.filter(n % 5 != 0).select("path", "text"), later.select("path", "text")


_STATUS = (
    "status AS (SELECT path, CASE WHEN file_id % 7 = 0 THEN 'vanished' WHEN file_id % 5 = 0 THEN 'new' WHEN file_id % 3 = 0 THEN 'changed' ELSE 'same' END AS status "
    "FROM files WHERE file_id % 7 <> 0 OR file_id % 5 <> 0)"
)


@query("changed_files", f"WITH {FILES}, {_STATUS} SELECT path, status FROM status")
def _(spark, sf_dir):
    place = _work_folder(spark, "changes")
    before, now = _snapshots(spark, sf_dir)
    changes.file_manifest(before).write.parquet(place)
    return changes.diff_manifests(spark.read.parquet(place), changes.file_manifest(now))


@query(
    "scan_changed",
    f"{ALL_FOUND}, {_STATUS} SELECT {WHOLE}, status FROM found JOIN status USING (path) JOIN files USING (path) "
    "WHERE status IN ('new', 'changed') AND NOT (file_id % 3 = 0 AND contains(message, 'requests'))",
)
def _(spark, sf_dir):
    """Findings of the files that are new or changed against a stored manifest; no other file is parsed."""
    place = _work_folder(spark, "changes")
    before, now = _snapshots(spark, sf_dir)
    changes.file_manifest(before).write.parquet(place)
    found, _ = changes.scan_changed(now, spark.read.parquet(place))
    return whole(found, "rule_order", "status")


# Index of lines

_PATTERN = r"\bthe\b.*[a-z]tion[.,]"
_GREP = (
    f"WITH {FILES}, l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_num "
    f"FROM (SELECT path, string_split(text, chr(10)) AS ls FROM files)), hits AS (SELECT * FROM l WHERE regexp_matches(line, '{_PATTERN}'))"
)


def _index(spark: SparkSession, sf_dir: str) -> text_index.LineIndex:
    return text_index.write_line_index(fx.code_files(spark, sf_dir).select("path", "text"), _work_folder(spark, "lines"), blocks=8)


@query("grep_indexed", f"{_GREP} SELECT path, line_num, trim(line) AS line FROM hits")
def _(spark, sf_dir):
    return text_index.grep_indexed(_index(spark, sf_dir), _PATTERN)


@query(
    "grep_report",
    f"{_GREP} SELECT count(*) AS n_lines, count(*) FILTER (contains(line, 'the') AND contains(line, 'tio') AND contains(line, 'ion')) AS n_read, "
    "(SELECT count(*) FROM hits) AS n_found FROM l",
)
def _(spark, sf_dir):
    """How many lines the index leaves to be tried."""
    return text_index.grep_report(_index(spark, sf_dir), _PATTERN)


# Report folders


def _report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool, path, report): reports of three tools, every 17th cut short, and some from nobody we know or about nothing."""
    named = [
        (name, make(spark, sf_dir).select("path", F.col("json").alias("report")))
        for name, make in (("ruff", fx.ruff_reports), ("eslint", fx.eslint_reports), ("golangci", fx.golangci_reports))
    ]
    n = F.col("doc_id")
    odd = fx.table(spark, sf_dir, "documents").filter(n % 10 < 3).select(
        F.when(n % 10 == 0, "hadolint").otherwise("clippy").alias("tool"),
        F.when(n % 10 != 1, fx._path(".rs", "native")).alias("path"),
        F.when(n % 10 != 2, F.lit("{}")).alias("report"),
    )
    united = odd
    for name, reports in named:
        united = united.unionByName(reports.withColumn("tool", F.lit(name)))
    return united


def _report_folder(spark: SparkSession, sf_dir: str) -> str:
    place = _work_folder(spark, "reports")
    report_folder.write_reports(_report_documents(spark, sf_dir), f"{place}/in")
    broken = fx.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 10 == 3).select(F.lit('{"path": "/w/x.py", "rep').alias("value"), F.lit("ruff").alias("tool"))
    broken.write.mode("append").partitionBy("tool").text(f"{place}/in")
    return place


_DOCS = "docs AS (SELECT doc_id, text, doc_id % 4 AS k, doc_id % 17 <> 0 AS good, '/w/p' || (doc_id % 5) AS owner FROM documents)"
_IMPORTED = (
    f"WITH {_DOCS} SELECT owner || CASE WHEN doc_id % 2 = 1 THEN '/tests/f' || doc_id || '_test.py' ELSE '/src/f' || doc_id || '.py' END AS path, "
    "'python' AS language, (doc_id % 50 + 1)::INT AS line_num, 'S101' AS violation_type, 'assert used' AS message FROM docs WHERE good AND k >= 1 "
    "UNION ALL SELECT owner || CASE WHEN doc_id % 2 = 1 THEN '/tests/f' || doc_id || '_test.py' ELSE '/src/f' || doc_id || '.py' END, 'python', 2, 'F401', text "
    "FROM docs WHERE good AND k >= 2 AND NOT contains(text, 'SyntaxError') "
    "UNION ALL SELECT owner || '/web/f' || doc_id || '.ts', 'typescript', (doc_id % 40 + 1)::INT, 'eslint_no-undef', text FROM docs WHERE good AND k >= 1 "
    "UNION ALL SELECT owner || '/web/f' || doc_id || '.ts', 'typescript', 0, 'eslint_unknown', 'parsing failed' FROM docs WHERE good AND k >= 3 "
    "UNION ALL SELECT owner || '/cmd/f' || doc_id || '.go', 'go', 4, 'golangci_errcheck', text FROM docs WHERE good AND k >= 1 "
    "UNION ALL SELECT owner || '/cmd/f' || doc_id || '.go', 'go', 6, 'golangci_unknown', 'no linter' FROM docs WHERE good AND k >= 3"
)
_PLACE = ["path", "language", "line_num", "violation_type", "message"]


@query("report_source", _IMPORTED)
def _(spark, sf_dir):
    """All reports of a folder as findings."""
    documents = report_folder.read_reports(spark, f"{_report_folder(spark, sf_dir)}/in")
    return report_folder.import_reports(documents).select(*_PLACE)


@query("report_stream", _IMPORTED)
def _(spark, sf_dir):
    """The same from a stream over the folder."""
    place = _report_folder(spark, sf_dir)
    found = report_folder.import_reports(report_folder.stream_reports(spark, f"{place}/in")).select(*_PLACE)
    return _drain(found, place)


@query(
    "report_quarantine",
    f"WITH {_DOCS}, q AS (SELECT unnest(['ruff', 'eslint', 'golangci']) AS tool, 'report cut short' AS reason, doc_id FROM docs WHERE NOT good "
    "UNION ALL SELECT 'hadolint', 'unknown tool', doc_id FROM docs WHERE doc_id % 10 = 0 UNION ALL SELECT 'clippy', 'no path', doc_id FROM docs WHERE doc_id % 10 = 1 "
    "UNION ALL SELECT 'clippy', 'no report', doc_id FROM docs WHERE doc_id % 10 = 2 UNION ALL SELECT 'ruff', 'not JSON', doc_id FROM docs WHERE doc_id % 10 = 3) "
    "SELECT tool, reason, count(*) AS n FROM q GROUP BY ALL",
)
def _(spark, sf_dir):
    """What could not be imported, by tool and reason."""
    documents = report_folder.read_reports(spark, f"{_report_folder(spark, sf_dir)}/in")
    return report_folder.quarantine(documents).groupBy("tool", "reason").agg(F.count(F.lit(1)).alias("n"))
