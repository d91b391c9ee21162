"""Report folders: what tools left behind, as findings, with what cannot be read set aside.

A folder holds JSON lines, one report document each, in ``tool=<name>`` folders: the file the tool
was run on and its output as it was printed.  Spark's file source reads them, in batch or as a
stream, whose checkpoint remembers the files that are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.sources import linters

DOCUMENT = "path string, report string"
# The tools there are importers for: how their output is read, and what it looks like when it is whole.
_WHOLE_DOCUMENT: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "ruff": (linters.import_ruff, "array"),
    "eslint": (linters.import_eslint, "array"),
    "golangci": (linters.import_golangci, "object"),
}
_LINES = ("tsc", "clippy")
TOOLS = [*_WHOLE_DOCUMENT, *_LINES]


def write_reports(reports: DataFrame, folder: str) -> None:
    """Adds (tool, path, report) to a folder."""
    document = F.to_json(F.struct("path", "report")).alias("value")
    reports.select(document, "tool").write.mode("append").partitionBy("tool").text(folder)


def _parsed(raw: DataFrame) -> DataFrame:
    """(tool, path, report, raw, source_file, reason); reason is null for a document that can be imported.

    A document whose path cannot be read leaves the fields null and is set aside, not lost.
    """
    document = F.from_json("value", DOCUMENT)
    kind = F.substring(F.ltrim(F.col("d.report")), 1, 1)
    is_json = F.try_parse_json(F.col("d.report")).isNotNull()
    arrays, objects = ([t for t, (_, k) in _WHOLE_DOCUMENT.items() if k == wanted] for wanted in ("array", "object"))
    cut = (
        F.when(F.col("tool").isin(arrays), ~((kind == "[") & is_json))
        .when(F.col("tool").isin(objects), ~((kind == "{") & is_json))
        .otherwise(F.lit(False))
    )
    reason = (
        F.when(~F.col("tool").isin(TOOLS), "unknown tool")
        .when(F.col("d").isNull() | F.try_parse_json(F.col("value")).isNull(), "not JSON")
        .when(F.coalesce(F.col("d.path"), F.lit("")) == "", "no path")
        .when(F.col("d.report").isNull(), "no report")
        .when(F.coalesce(cut, F.lit(True)), "report cut short")
    )
    return raw.withColumn("d", document).select(
        "tool", F.col("d.path").alias("path"), F.col("d.report").alias("report"), F.col("value").alias("raw"), "source_file", reason.alias("reason")
    )


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder; see ``_parsed``."""
    raw = spark.read.schema("value string, tool string").text(folder)
    return _parsed(raw.select("value", "tool", F.col("_metadata.file_path").alias("source_file")))


def stream_reports(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The same as a stream; a file is read once, also after a restart."""
    raw = spark.readStream.schema("value string, tool string").options(**options).text(folder)
    return _parsed(raw.select("value", "tool", F.col("_metadata.file_path").alias("source_file")))


def quarantine(documents: DataFrame) -> DataFrame:
    """(tool, source_file, reason, raw) of the documents that cannot be imported."""
    return documents.filter(F.col("reason").isNotNull()).select("tool", "source_file", "reason", "raw")


def import_reports(documents: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Findings of all documents that can be imported.

    Tools are told apart by their folder, so each importer opens only its own.  ``markers`` tells where compiler
    configurations are (see ``import_tsc``); on a stream, leave it out.
    """
    good = documents.filter(F.col("reason").isNull())
    found = [run(good.filter(F.col("tool") == tool).select("path", F.col("report").alias("json"))) for tool, (run, _) in _WHOLE_DOCUMENT.items()]
    lines = good.filter(F.col("tool").isin(list(_LINES))).select("tool", "path", F.explode(F.split("report", "\n")).alias("line"))
    found.append(linters.import_tsc(lines.filter(F.col("tool") == "tsc").select("path", "line"), markers))
    found.append(linters.import_clippy(lines.filter(F.col("tool") == "clippy").select("path", "line")))
    united = found[0]
    for other in found[1:]:
        united = united.unionByName(other)
    return united
