"""Path helpers as column expressions; paths are taken as canonical, '/'-separated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def suffix(path: Column) -> Column:
    """Last suffix with its dot; hidden names and a trailing dot have none."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_replace(suffix(path), r"^\.", ""))


def dir_at_depth(directory: Column, depth: Column) -> Column:
    """The ancestor of ``directory`` made of its first ``depth`` name parts."""
    lead = F.when(directory.startswith("/"), 1).otherwise(0)
    return F.array_join(F.slice(F.split(directory, "/"), F.lit(1), depth.cast("int") + lead), "/")


def depth_of(directory: Column) -> Column:
    """Number of name parts; 0 for the root and for the current directory."""
    parts = F.size(F.split(directory, "/"))
    return F.when(directory == "", 0).when(directory.startswith("/"), parts - 1).otherwise(parts)


def depths(directory: Column) -> Column:
    """1..depth as an array, empty for a directory without name parts."""
    n = depth_of(directory)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def is_test_strict(path: Column) -> Column:
    low = F.lower(path)
    name = base_name(low)
    return (
        name.startswith("test_")
        | name.endswith("_test.py")
        | F.contains(low, F.lit("/tests/"))
        | F.contains(low, F.lit("/test/"))
    )


def is_test_loose(path: Column) -> Column:
    return F.contains(path, F.lit("test"))


def is_test_naming(path: Column) -> Column:
    name = base_name(path)
    return (
        F.contains(name, F.lit("test_"))
        | name.endswith("_test.py")
        | F.contains(path, F.lit("tests/"))
    )


def project_hash(root: Column) -> Column:
    """Short project id; files outside any project share one id."""
    return F.coalesce(F.substring(F.md5(root.cast("binary")), 1, 8), F.lit("unknown"))
