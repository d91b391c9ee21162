"""Source files from a directory tree, or from a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.corpus import LANGUAGE_BY_SUFFIX


def scan_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modification_time, content), one row per file below ``root``.

    The glob prunes the listing, a filter on ``length`` reaches the scan, and ``content`` is
    not read unless it is used.  For trees of many small files, lower the session's
    spark.sql.files.openCostInBytes (64 KiB, say), so that one task takes thousands of them.  Files that vanish during the scan are skipped; compare with
    a manifest (``gate_access``) to report them.  The ``file:`` scheme is cut off local paths.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    reader = reader.option("pathGlobFilter", glob or "*{" + ",".join(LANGUAGE_BY_SUFFIX) + "}")
    return reader.load(root).select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        "length",
        F.col("modificationTime").alias("modification_time"),
        "content",
    )


def files_table(spark: SparkSession, location: str, path: str = "path", text: str = "text") -> DataFrame:
    """(path, text) from a parquet table of source files: the form for large corpora, since a
    split then holds many small files."""
    return spark.read.parquet(location).select(F.col(path).alias("path"), F.col(text).alias("text"))
