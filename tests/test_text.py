"""Text and path expressions against what Python does."""

import fnmatch
import re
from pathlib import PurePosixPath

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions import text as X
from lintlake.operators import corpus

BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
RELAXED = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [row[0] for row in df.orderBy("i").select(column.alias("v")).collect()]


@RELAXED
@given(st.lists(st.text(alphabet="ab \t" + BREAKS, max_size=12), min_size=30, max_size=60))
def test_lines_like_splitlines(spark, texts):
    assert values(spark, texts, X.line_array("text")) == [t.splitlines() for t in texts]


@RELAXED
@given(st.lists(st.text(alphabet="ab\x1f\xa0\u3000 \t" + BREAKS, max_size=8), min_size=30, max_size=60))
def test_strip_and_blank(spark, texts):
    assert values(spark, texts, X.py_strip(F.col("text"))) == [t.strip() for t in texts]
    assert values(spark, texts, X.is_blank(F.col("text"))) == [not t.strip() for t in texts]


@RELAXED
@given(st.lists(st.text(alphabet="ab\r\n\x0b", max_size=10), min_size=30, max_size=60))
def test_newlines_and_count(spark, texts):
    plain = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    assert values(spark, texts, X.normalize_newlines(F.col("text"))) == plain
    counts = [t.count("\n") + (1 if t and not t.endswith("\n") else 0) for t in plain]
    assert values(spark, texts, X.line_count(F.col("text"))) == counts


@RELAXED
@given(st.data())
def test_globs_like_fnmatch(spark, data):
    globs = data.draw(st.lists(st.text(alphabet="ab.*?[]!-^\\+", max_size=7), min_size=30, max_size=50))
    names = data.draw(st.lists(st.text(alphabet="ab.]!-^[\\+", max_size=5), min_size=8, max_size=12))
    pairs = [(g, n) for g in globs for n in names]
    df = spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate(pairs)], "i int, g string, n string")
    got = df.orderBy("i").select(F.rlike(F.col("n"), X.glob_to_regex(F.col("g")))).collect()
    want = [fnmatch.fnmatchcase(n, g) for g, n in pairs]
    wrong = [(p, w) for p, r, w in zip(pairs, got, want) if r[0] != w]
    assert not wrong, wrong[:3]


def test_suffix_like_pathlib(spark):
    paths = ["/a/b.py", "/a/.env", "/a/x.", "/a/b.tar.gz", "/a/noext", "b.PY", "/a.b/c", "/a/.hid.py", "/a/..py"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string").orderBy("i")
    got = [r[0] for r in df.select(P.suffix(F.col("path"))).collect()]
    want = [("" if PurePosixPath(p).name.endswith(".") else PurePosixPath(p).suffix) for p in paths]
    assert got == want
    assert [r[0] for r in df.select(P.file_extension(F.col("path"))).collect()] == [w.lower().lstrip(".") for w in want]


def test_ancestors(spark):
    df = spark.createDataFrame([("/w/p/src/a.py",), ("/a.py",), ("a.py",), ("x/y/a.py",)], "path string")
    d = P.parent_dir(F.col("path"))
    dirs = F.transform(P.depths(d), lambda n: P.dir_at_depth(d, n))
    assert [r[0] for r in df.select(dirs).collect()] == [["/w", "/w/p", "/w/p/src"], [], [], ["x", "x/y"]]


def test_three_test_file_predicates(spark):
    cases = {
        "/p/tests/thing.py": (True, True, True),
        "/p/test/thing.py": (True, True, False),
        "/p/test_a.py": (True, True, True),
        "/p/a_test.py": (True, True, True),
        "/p/Test_A.py": (True, False, False),
        "tests/thing.py": (False, True, True),
        "/p/utils_test_helpers.py": (False, True, True),
        "/p/testing_helpers.py": (False, True, False),
        "/p/service.py": (False, False, False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    path = F.col("path")
    for row in df.select("path", P.is_test_strict(path), P.is_test_loose(path), P.is_test_naming(path)).collect():
        assert tuple(row[1:]) == cases[row[0]], row[0]


def test_grep_splits_on_lf_only(files):
    found = corpus.grep(files(("/a.py", " one\x0ctwo \nthree\n")), r"t(wo|hree)").collect()
    assert [(r.line_num, r.line) for r in found] == [(1, "one\x0ctwo"), (2, "three")]


def test_patterns_are_unicode_like_python(files):
    text = "x = é1\nabc\n"
    assert corpus.grep(files(("/a.py", text)), r"\w1").count() == len(re.findall(r"\w1", text))
