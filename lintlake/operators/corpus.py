"""From raw files to routed, gated, decoded text: narrow steps only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.functions.findings import (
    GATES,
    explode_findings,
    explode_items,
    finding,
    no_findings,
    order_key,
)

# Which suffix belongs to which language pack.
LANGUAGE_BY_SUFFIX = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "typescript",
    ".jsx": "typescript",
    ".rs": "rust",
    ".go": "go",
}

# Fixed value: a customary limit for the size of a Python file.
MAX_FILE_BYTES = 10 * 1024 * 1024


def language_of(path: Column, extensions: dict[str, str] | None = None, strict_case: bool = True) -> Column:
    """The language pack of a path, or null.

    With ``strict_case`` an upper-case suffix is routed nowhere, because the packs compare
    the suffix as written.
    """
    table = F.create_map(*[F.lit(x) for pair in (extensions or LANGUAGE_BY_SUFFIX).items() for x in pair])
    ending = P.suffix(path)
    language = F.try_element_at(table, F.lower(ending))
    return F.when(ending == F.lower(ending), language) if strict_case else language


def route_language(
    files: DataFrame, extensions: dict[str, str] | None = None, strict_case: bool = True
) -> DataFrame:
    routed = files.withColumn("language", language_of(F.col("path"), extensions, strict_case))
    return routed.filter(F.col("language").isNotNull())


def with_gate(files: DataFrame, python_only: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Adds ``gate``: ok, too_large, binary, encoding, blank or undecodable; and ``text``.

    ``text`` is null unless the gate is ok or too_large, so no later step can look at a refused
    file.  A file above ``max_bytes`` is reported and analysed all the same.
    Files come either with ``content`` (bytes) or with ``text``.
    """
    if "content" in files.columns:
        size = F.col("length") if "length" in files.columns else F.octet_length("content")
        decoded = F.col("content").cast("string")
        valid = F.is_valid_utf8(decoded)
    else:
        size = F.octet_length("text")
        decoded = F.col("text")
        valid = F.is_valid_utf8("text")
    gated = (F.col("language") == "python") if python_only else F.lit(True)
    gate = (
        F.when(gated & (F.locate("\0", decoded) > 0), "binary")
        .when(~valid, F.when(gated, "encoding").otherwise("undecodable"))
        .when(gated & X.is_blank(decoded), "blank")
        .when(gated & (size > max_bytes) if max_bytes is not None else F.lit(False), "too_large")
        .otherwise("ok")
    )
    marked = files.withColumn("gate", gate).withColumn("gate_bytes", size.cast("long"))
    return marked.withColumn("text", F.when(F.col("gate").isin("ok", "too_large"), X.normalize_newlines(decoded)))


def gate_findings(path: Column, gate: Column, n_bytes: Column, max_bytes: int | None = None) -> Column:
    """The finding of a Python file that is refused or too large."""

    def row(kind: str, message: Column, fix: str) -> Column:
        return F.array(finding(0, kind, "error", message, fix, order=order_key(GATES, F.lit(0))))

    limit = f"{max_bytes or 0:,}"
    return (
        F.when(
            gate == "too_large",
            row(
                "file_too_large",
                F.concat(F.lit("File has "), F.format_number(n_bytes, 0), F.lit(f" bytes, the limit is {limit}")),
                "Split the file",
            ),
        )
        .when(
            gate == "binary",
            row("binary_file_error", F.concat(F.lit("File looks binary: "), path), "Keep only text under this suffix"),
        )
        .when(
            gate == "encoding",
            row("encoding_error", F.concat(F.lit("File is not UTF-8: "), path), "Save the file as UTF-8"),
        )
        .otherwise(no_findings())
    )


def gate(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files that may be analysed, findings of those that are refused or too large)."""
    marked = with_gate(files, max_bytes=max_bytes)
    refused = explode_findings(marked, gate_findings(F.col("path"), F.col("gate"), F.col("gate_bytes"), max_bytes))
    return marked.filter(F.col("gate").isin("ok", "too_large")).drop("gate", "gate_bytes"), refused


def gate_access(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings for files that were listed but not read.

    ``manifest`` has path and, if known, status (stat, denied, missing or io) and length:
    Spark does not list empty files, so those are not reported as lost.
    """
    if "length" in manifest.columns:
        manifest = manifest.filter(F.col("length") > 0)
    status = F.col("status") if "status" in manifest.columns else F.lit(None).cast("string")
    lost = manifest.join(scanned.select("path"), "path", "left_anti").withColumn(
        "language", language_of(F.col("path"))
    )
    kind = (
        F.when(status == "stat", "file_stat_error").when(status == "io", "io_error").otherwise("file_access_error")
    )
    row = finding(
        0,
        kind,
        "error",
        F.concat(F.lit("File could not be read: "), F.col("path")),
        "Check that the file exists and may be read",
        order=order_key(GATES, F.lit(0)),
    )
    return explode_findings(lost.filter(F.col("language") == "python"), F.array(row))


def split_lines(files: DataFrame, *keep: str) -> DataFrame:
    """(path, ..., line_num, line), numbered from 1."""
    numbered = explode_items(files, ["path", *keep], X.line_array("text"), "pos", "line")
    return numbered.select("path", *keep, (F.col("pos") + 1).alias("line_num"), "line")


def count_lines(files: DataFrame) -> DataFrame:
    """(path, n_lines); a file that is not UTF-8 counts 0."""
    text = F.col("content").cast("string") if "content" in files.columns else F.col("text")
    counted = F.when(F.is_valid_utf8(text), X.line_count(text)).otherwise(0)
    return files.select("path", counted.cast("long").alias("n_lines"))


def grep(files: DataFrame, regex: str) -> DataFrame:
    """(path, line_num, line) of matching lines, split on LF only, trimmed."""
    numbered = explode_items(files, ["path"], F.split("text", "\n", -1), "pos", "line")
    hits = numbered.filter(F.col("line").rlike(X.py_regex(regex)))
    return hits.select("path", (F.col("pos") + 1).alias("line_num"), X.py_strip(F.col("line")).alias("line"))
