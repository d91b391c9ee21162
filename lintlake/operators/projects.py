"""Which project a file belongs to: nearest-ancestor joins of files to project markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.joins import salt_of, salted_join

# Project markers in rank order, with the priority class of each.
MARKERS = {
    ".git": 1,
    "pyproject.toml": 2,
    "setup.py": 2,
    "package.json": 2,
    "Cargo.toml": 2,
    "go.mod": 2,
    "pom.xml": 2,
    "build.gradle": 2,
    "Gemfile": 2,
    "mix.exs": 2,
    "composer.json": 2,
    ".claude": 3,
    "CLAUDE.md": 3,
}
# Markers of a development project.
DEVELOPMENT_MARKERS = [".claude", "CLAUDE.md", "pyproject.toml", "package.json"]
# Project type by the first of these at the root.
TYPE_BY_MARKER = {
    "pyproject.toml": "python",
    "package.json": "javascript",
    "Cargo.toml": "rust",
    "go.mod": "go",
    "pom.xml": "java",
}

# (priority, depth, marker set) packed into one integer, so that the best ancestor of a
# directory is a plain MIN over longs: hash aggregation, combined before the shuffle.
_MASK_BITS = 1 << len(MARKERS)
_DEPTH_RANGE = 1 << 20


def markers_by_dir(markers: DataFrame) -> DataFrame:
    """(dir, priority, mask): one row per directory that holds a known marker."""
    known = markers.filter(F.col("marker").isin(list(MARKERS)))
    table = F.create_map(*[F.lit(x) for name, level in MARKERS.items() for x in (name, level)])
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(MARKERS) for x in (name, 1 << i)])
    return known.groupBy("dir").agg(
        F.min(table[F.col("marker")]).alias("priority"), F.bit_or(bits[F.col("marker")]).alias("mask")
    )


def _has(mask: Column, marker: str) -> Column:
    return mask.bitwiseAND(1 << list(MARKERS).index(marker)) != 0


def marker_list(mask: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_has(mask, name), F.lit(name)) for name in MARKERS]))


def is_development(mask: Column) -> Column:
    result = F.lit(False)
    for name in DEVELOPMENT_MARKERS:
        result = result | _has(mask, name)
    return F.coalesce(result, F.lit(False))


def type_of(mask: Column) -> Column:
    result = F.lit(None)
    for name, kind in reversed(TYPE_BY_MARKER.items()):
        result = F.when(_has(mask, name), kind).otherwise(result)
    return F.coalesce(result, F.lit("unknown"))


def _salted_dirs(files: DataFrame) -> DataFrame:
    """Files with their directory and a salt: a directory with many files has several salts,
    one with few files has few, so the table of distinct (dir, salt) stays small."""
    return files.withColumn("_dir", P.parent_dir(F.col("path"))).withColumn("_salt", salt_of("path"))


def _with_ancestors(dirs: DataFrame) -> DataFrame:
    exploded = dirs.withColumn("_depth", F.explode_outer(P.depths(F.col("_dir")))).filter(F.col("_depth").isNotNull())
    return exploded.withColumn("dir", P.dir_at_depth(F.col("_dir"), F.col("_depth")))


def attribute_project(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds root, project_hash, markers, is_development_project, context_message, project_type.

    Every ancestor directory is tested; the best marker class wins, then the deepest
    directory.  The work is done per distinct directory, not per file.  The rows of ``files``
    are shuffled as they come, so give paths or findings, not texts.
    """
    salted = _salted_dirs(files)
    ancestors = _with_ancestors(salted.select("_dir", "_salt").distinct())
    # Shallow ancestors are shared by all directories: spread them too.
    marked = salted_join(ancestors, markers_by_dir(markers), ["dir"])
    packed = (F.col("priority").cast("long") * _DEPTH_RANGE - F.col("_depth")) * _MASK_BITS + F.col("mask")
    best = marked.groupBy("_dir", "_salt").agg(F.min(packed).alias("_best"))
    joined = salted.join(best, ["_dir", "_salt"], "left")
    rank = F.floor(F.col("_best") / _MASK_BITS)
    mask = (F.col("_best") - rank * _MASK_BITS).cast("int")
    depth = (F.floor(rank / _DEPTH_RANGE) + 1) * _DEPTH_RANGE - rank
    root = F.when(F.col("_best").isNotNull(), P.dir_at_depth(F.col("_dir"), depth))
    development = is_development(mask)
    return joined.select(
        *[F.col(name) for name in files.columns],
        root.alias("root"),
        P.project_hash(root).alias("project_hash"),
        F.coalesce(marker_list(mask), F.array().cast("array<string>")).alias("markers"),
        development.alias("is_development_project"),
        F.when(development, "Development project: the full standards apply")
        .otherwise("Loose file: the basic standards apply")
        .alias("context_message"),
        type_of(mask).alias("project_type"),
    )


def root_markers(projects: DataFrame, markers: DataFrame) -> DataFrame:
    """(root, markers): the known markers at each root, in rank order."""
    roots = projects.select("root").filter(F.col("root").isNotNull()).distinct()
    at_root = roots.join(markers_by_dir(markers).withColumnRenamed("dir", "root"), "root", "left")
    return at_root.select("root", F.coalesce(marker_list(F.col("mask")), F.array().cast("array<string>")).alias("markers"))


def is_development_project(projects: DataFrame, markers: DataFrame) -> DataFrame:
    """The projects whose root holds one of the development markers."""
    hits = markers.filter(F.col("marker").isin(DEVELOPMENT_MARKERS)).select(F.col("dir").alias("root"))
    return projects.join(hits, "root", "left_semi")


def project_type(projects: DataFrame, markers: DataFrame) -> DataFrame:
    """(root, project_type)."""
    roots = projects.select("root").filter(F.col("root").isNotNull()).distinct()
    at_root = roots.join(markers_by_dir(markers).withColumnRenamed("dir", "root"), "root", "left")
    return at_root.select("root", type_of(F.col("mask")).alias("project_type"))


def nearest_config(files: DataFrame, markers: DataFrame, name: str) -> DataFrame:
    """Adds config_dir: the nearest ancestor directory that holds a file called ``name``."""
    salted = _salted_dirs(files)
    ancestors = _with_ancestors(salted.select("_dir", "_salt").distinct())
    holders = markers.filter(F.col("marker") == name).select("dir").distinct()
    nearest = salted_join(ancestors, holders, ["dir"]).groupBy("_dir", "_salt").agg(F.max("_depth").alias("_depth"))
    joined = salted.join(nearest, ["_dir", "_salt"], "left")
    found = F.when(F.col("_depth").isNotNull(), P.dir_at_depth(F.col("_dir"), F.col("_depth")))
    return joined.select(*[F.col(c) for c in files.columns], found.alias("config_dir"))
