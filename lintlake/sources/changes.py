"""Scans of what has changed: a manifest of the files seen, and a full outer diff against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.plans.scan import scan_all
from lintlake.sources.tree import scan_tree

NEW, CHANGED, SAME, VANISHED = "new", "changed", "same", "vanished"


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, length, digest): one row per file with ``text`` or ``content``.

    The digest is a SHA-256, computed where the file is read; only it is handed on.
    """
    body = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    return files.select("path", F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))


def diff_manifests(previous: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """(path, status): new, changed, same or vanished, for every path of either manifest.

    Two files are the same if they agree in the columns ``by``: length and digest by default, length and
    modification_time for listings that were not read.  A path has one row in each.
    """
    columns = by or ("length", "digest")
    old = previous.select("path", F.struct(*columns).alias("_old"))
    both = old.join(current.select("path", F.struct(*columns).alias("_new")), "path", "full")
    status = (
        F.when(F.col("_old").isNull(), NEW)
        .when(F.col("_new").isNull(), VANISHED)
        .when(F.col("_old").eqNullSafe(F.col("_new")), SAME)
        .otherwise(CHANGED)
    )
    return both.select("path", status.alias("status"))


def changed_files(files: DataFrame, previous: DataFrame) -> DataFrame:
    """The files that are new or changed since ``previous``, with their ``status``.

    Digests are shuffled, texts are not unless more has changed than Spark broadcasts.
    """
    changed = diff_manifests(previous, file_manifest(files)).filter(F.col("status").isin(NEW, CHANGED))
    return files.join(changed, "path")


def scan_changed(files: DataFrame, previous: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(findings of new and changed files, status of every file): only what has changed is parsed.

    The findings carry ``status``; those of changed and vanished files in an older result are obsolete.
    """
    keep = (*options.pop("keep", ()), "status")
    found = scan_all(changed_files(files, previous), keep=keep, **options)
    return found, diff_manifests(previous, file_manifest(files))


def changed_tree(spark: SparkSession, root: str, previous: DataFrame, glob: str | None = None) -> DataFrame:
    """(path, status, length, modification_time, content) of a tree's new and changed files.

    ``previous`` is an earlier listing (path, length, modification_time).  The listings are compared first,
    without opening a file; then only files no older than the oldest changed one are opened.
    """
    by = ("length", "modification_time")
    listing = scan_tree(spark, root, glob).drop("content")
    changed = diff_manifests(previous, listing, *by).filter(F.col("status").isin(NEW, CHANGED))
    oldest = listing.join(changed, "path").agg(F.min("modification_time")).first()[0]
    files = scan_tree(spark, root, glob)
    # Without a change, no file is opened at all.
    files = files.filter(F.col("modification_time") >= F.lit(oldest)) if oldest is not None else files.limit(0)
    return files.join(changed, "path").select("path", "status", *by, "content")
