"""Project attribution on directory trees, and exceptions per project."""

import hashlib

from pyspark.sql import functions as F

from lintlake.functions.joins import salted_join
from lintlake.operators import projects
from lintlake.operators.allow_list import apply_allow_list
from lintlake.plans.scan import scan_all

DEEP = "/d/" + "/".join(f"l{i}" for i in range(20))

MARKERS = [
    ("/mono", ".git"), ("/mono/packages/a", "package.json"), ("/mono/packages/a", "tsconfig.json"),
    ("/nested", ".git"), ("/nested/sub", ".git"),
    ("/py", "pyproject.toml"), ("/py/app", "setup.py"), ("/py/app/notes", "CLAUDE.md"),
    ("/only", ".claude"), ("/only", "CLAUDE.md"),
    ("/", ".git"), ("/d", "go.mod"), ("/other", "README.md"),
]
EXPECTED = {
    "/mono/packages/a/src/x.ts": "/mono",
    "/nested/sub/deep/x.py": "/nested/sub",
    "/nested/x.py": "/nested",
    "/py/app/notes/x.py": "/py/app",
    "/py/x.py": "/py",
    "/only/x.py": "/only",
    "/other/x.py": None,
    "/x.py": None,
    "x.py": None,
    f"{DEEP}/x.go": "/d",
    "/monolith/x.py": None,
}


def tables(spark):
    files = spark.createDataFrame([(p,) for p in EXPECTED], "path string")
    markers = spark.createDataFrame(MARKERS, "dir string, marker string")
    return files, markers


def test_roots(spark):
    rows = projects.attribute_project(*tables(spark)).collect()
    assert {r.path: r.root for r in rows} == EXPECTED
    for row in rows:
        want = hashlib.md5(row.root.encode()).hexdigest()[:8] if row.root else "unknown"
        assert row.project_hash == want


def test_markers_and_types(spark):
    files, markers = tables(spark)
    rows = {r.path: r for r in projects.attribute_project(files, markers).collect()}
    assert rows["/only/x.py"].markers == [".claude", "CLAUDE.md"]
    assert rows["/py/x.py"].project_type == "python" and rows[f"{DEEP}/x.go"].project_type == "go"
    assert rows["/py/x.py"].is_development_project and not rows["/mono/packages/a/src/x.ts"].is_development_project
    assert rows["/other/x.py"].markers == [] and rows["/other/x.py"].project_type == "unknown"
    roots = projects.root_markers(projects.attribute_project(files, markers), markers)
    assert {r.root: r.markers for r in roots.collect()}["/only"] == [".claude", "CLAUDE.md"]


def test_nearest_config(spark):
    files, markers = tables(spark)
    rows = {r.path: r.config_dir for r in projects.nearest_config(files, markers, "tsconfig.json").collect()}
    assert rows.pop("/mono/packages/a/src/x.ts") == "/mono/packages/a"
    assert set(rows.values()) == {None}


def test_one_directory_with_most_files(spark):
    """A hot directory is spread by the salt and every file still gets its root."""
    files = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("/hot/src/f"), "id", F.lit(".py")))
        .otherwise(F.concat(F.lit("/p"), F.col("id") % 50, F.lit("/f"), "id", F.lit(".py")))
        .alias("path")
    )
    markers = spark.createDataFrame([("/hot", ".git"), ("/p7", "go.mod")], "dir string, marker string")
    roots = projects.attribute_project(files, markers).groupBy("root").count().collect()
    assert sum(r["count"] for r in roots) == 20000
    assert {r.root for r in roots} == {"/hot", "/p7", None}


def test_salted_join_equals_join_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = spark.range(5000).select((F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id"))).alias("k"), "id")
        small = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        for how in ("inner", "left"):
            plain = large.join(small, ["k"], how)
            salted = salted_join(large, small, ["k"], how)
            assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_allow_list(spark, files):
    text = '"""A docstring that is long enough."""\n@patch("aws.put")\ndef test_x(m):\n    """D."""\n    Mock()\n'
    source = files(("/a/test_1.py", text), ("/b/test_2.py", text), ("/c/test_3.py", text)).withColumn(
        "project_hash", F.substring("path", 2, 1)
    )
    config = spark.createDataFrame(
        [("a", ["aws.*"]), ("b", ["AWS.*", "M?c[jk]"]), ("d", ["*"])], "project_hash string, allowed_patterns array<string>"
    )
    found = scan_all(source, config, keep=("project_hash",))
    rows = found.filter("violation_type = 'mock_violation'").collect()
    assert {(r.project_hash, r.language_context["mock_target"]) for r in rows} == {("a", "Mock"), ("b", "aws.put"), ("c", "aws.put"), ("c", "Mock")}
    everything = scan_all(source, keep=("project_hash",))
    assert found.filter("violation_type <> 'mock_violation'").count() == everything.filter("violation_type <> 'mock_violation'").count()
