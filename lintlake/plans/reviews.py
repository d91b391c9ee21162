"""One review of a file from our own findings and from the reports of its tools.

Own findings come out of the narrow scan; reports are joined to the files that may be analysed.  Both
get one order: in Python files the reports come last, in other languages they come first, and
among the tools of a language the linter is before the compiler.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.findings import REPORTS
from lintlake.operators.corpus import route_language
from lintlake.operators.reports import decide, decide_pages
from lintlake.plans.scan import prepare, scan_all
from lintlake.schemas import VIOLATION_COLUMNS

_GROUP = 10_000_000_000
# Findings of the second tool of a language, and the files it looks at.
COMPILER_TYPES = ["typescript_", "tsc_"]
COMPILER_SUFFIXES = [".ts", ".tsx"]


def reviewed_files(files: DataFrame, *keep: str, extensions: dict[str, str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, language, ...): files whose reports count, that is all that were not refused and, in Python, not blank.

    Only the gates are evaluated; texts stay where they are.
    """
    return prepare(files, extensions, max_bytes=max_bytes).filter(F.col("gate").isin("ok", "too_large")).select("path", "language", *keep)


def _from_compiler() -> Column:
    kind = F.col("violation_type")
    return kind.startswith(COMPILER_TYPES[0]) | kind.startswith(COMPILER_TYPES[1])


def ordered_reports(reports: DataFrame) -> DataFrame:
    """Report findings with their place in the order of all findings of a file.

    ``rule_order`` of an importer is the place within one report; the tool decides about the rest.
    """
    place = F.pmod("rule_order", F.lit(_GROUP))
    first = F.when(_from_compiler(), -1).otherwise(-2)
    group = F.when(F.col("language") == "python", REPORTS).otherwise(first)
    return reports.withColumn("rule_order", group.cast("long") * _GROUP + place)


# Hash values of files that a bit each is kept for: bitmaps of 16 MB in all, however many files there are.
_HASHES = 1 << 27


def _about_files(reports: DataFrame, files: DataFrame, extensions: dict[str, str] | None) -> DataFrame:
    """``reports`` without most of those about no routed file; a join has to follow.

    One bit for each hash of a (path, language) is sent to the reports, so that messages about other files are not shuffled.
    Only paths are read for it.  Files that share a bit with another one let some reports pass, and none is lost.
    """
    value = F.pmod(F.xxhash64("path", "language"), F.lit(_HASHES))
    bucket, place = F.bitmap_bucket_number(value), F.bitmap_bit_position(value)
    routed = route_language(files.select("path"), extensions)
    bits = routed.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_place % 8 AS int)) & 1") == 1
    met = reports.withColumn("_bucket", bucket).join(F.broadcast(bits), "_bucket")
    return met.withColumns({"_byte": byte, "_place": place}).filter(is_set).select(reports.columns)


def scan_with_reports(files: DataFrame, reports: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """All findings on each file, from the rules and from the reports of its tools.

    ``files`` has one row a path; ``reports`` are findings of the importers, all tools united.
    Reports about other files, about refused files and from the compiler about plain scripts
    are left out.  ``options`` are those of ``scan_all``.  Own findings are not shuffled.  Reports about
    other files are mostly set aside before the shuffle (see ``_about_files``).  The rest
    meet their files in a plain join, so adaptive execution splits the reports of a hot file.
    """
    gates = {name: options[name] for name in ("extensions", "max_bytes") if name in options}
    own = scan_all(files, keep=keep, **options)
    known = reviewed_files(files, *keep, **gates)
    fitting = reports.filter(~_from_compiler() | P.suffix(F.col("path")).isin(COMPILER_SUFFIXES))
    near = _about_files(fitting.select(VIOLATION_COLUMNS), files, options.get("extensions"))
    reported = ordered_reports(near).join(known, ["path", "language"])
    return own.unionByName(reported.select(own.columns))


def decide_with_reports(files: DataFrame, reports: DataFrame, page_errors: int | None = None, **options) -> DataFrame:
    """Block or approve every routed file from own findings and reports together; reasons in rule order.

    With ``page_errors`` a reason comes in pages of so many errors (see ``decide_pages``).
    """
    gates = {name: options[name] for name in ("extensions", "max_bytes") if name in options}
    fixes = ["fixes"] if "fixes" in files.columns else []
    routed = prepare(files, **gates).select("path", *fixes)
    found = scan_with_reports(files, reports, **options)
    return decide_pages(found, routed, page_errors) if page_errors else decide(found, routed)
