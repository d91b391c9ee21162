"""Rules on small files: what must be found, and what must not."""

import pytest

from lintlake.operators import corpus, facts, file_rules, line_rules
from lintlake.operators.rulebook import LineRule, banned_names
from lintlake.plans.packs import PackRegistry
from lintlake.plans.scan import scan_all
from workloads import fixtures as fx

DOC = '"""A docstring that is long enough."""\n'


def kinds(found):
    return [kind for kind, _, _ in found]


def of_type(found, kind):
    return [(line, severity) for k, line, severity in found if k == kind]


# The matrix of the plain templates, derived by hand: template -> findings.
MATRIX = {
    0: [],
    1: [("banned_import", 2), ("banned_import", 4), ("banned_import", 5), ("local_directory_import", 3), ("local_directory_import", 4)],
    2: [
        ("antipattern", 1), ("environment_variable_handling", 4), ("gil_confusion", 1), ("missing_docstring", 3),
        ("missing_module_docstring", 1), ("path_handling", 5), ("security_violation", 5),
    ],
    3: [
        ("banned_import", 3), ("debug_pattern", 11), ("mock_violation", 4), ("mock_violation", 7), ("mock_violation", 10),
        ("test_naming_convention", 8),
    ],
    4: [("dataclass_opportunity", 5), ("enum_opportunity", 1), ("missing_docstring", 1), ("missing_module_docstring", 1)],
    5: [
        ("identity_comparison_gotcha", 4), ("identity_comparison_gotcha", 6), ("identity_comparison_gotcha", 12),
        ("inadequate_module_docstring", 1), ("match_case_opportunity", 4), ("match_case_opportunity", 6),
    ],
    6: [("banned_package_import", 1), ("banned_package_import", 2), ("console_usage", 4)],
    7: [("banned_package_import", 1), ("console_usage", 2)],
    8: [("banned_crate_usage", 1), ("banned_crate_usage", 3)],
    9: [("banned_package_usage", 2), ("error_ignoring", 7), ("panic_abuse", 8)],
    10: [],
    11: [("composition_violation", 1), ("error_handling", 1), ("missing_pathlib", 1), ("old_formatting", 1)],
}


def test_template_matrix(spark, sf_dir):
    source = fx.code_files(spark, sf_dir, with_text=False)
    rows = scan_all(source.withColumn("file_id", source.file_id.cast("string")), keep=("file_id",)).collect()
    found = {}
    for row in rows:
        found.setdefault(int(row.file_id), []).append((row.violation_type, row.line_num))
    for (file_id,) in source.select("file_id").collect():
        assert sorted(found.get(file_id, [])) == sorted(MATRIX[file_id % 12]), file_id


def test_banned_prefix_is_not_substring(scan):
    text = DOC + "import pipeline_tool\nimport pip\nimport pip.x\nfrom pip import y\nfrom . import pip\nfrom .pip import z\n"
    assert of_type(scan(("/a.py", text)), "banned_import") == [(3, "error"), (4, "error"), (5, "error"), (7, "error")]


def test_unittest_in_tests(files, spark):
    text = DOC + "import unittest\nimport unittest.mock\nimport urllib.parse\n"
    rows = scan_all(files(("/p/test_x.py", text), ("/p/x.py", text))).filter("violation_type = 'banned_import'").collect()
    got = {(r.path, r.language_context["import_name"], "pytest fixtures" in r.fix_suggestion) for r in rows}
    assert got == {("/p/test_x.py", "unittest", True), ("/p/x.py", "unittest", False), ("/p/x.py", "unittest.mock", False)}


def test_banned_names_by_join_equal_literals(files, spark):
    text = DOC + "import requests\nfrom os.path import join\nimport urllib.request, pandas.io\nimport numpy\n"
    table = facts.extract_py_facts(corpus.route_language(files(("/a.py", text), ("/test/b.py", text + "import unittest\n"))))
    from lintlake.operators.fact_rules import rule_banned_import

    def keyed(df):
        return sorted((r.path, r.line_num, r.message, r.fix_suggestion, r.language_context["banned_module"], r.rule_order) for r in df.collect())

    assert keyed(rule_banned_import(table)) == keyed(rule_banned_import(table, banned_names(spark)))


def test_line_names_by_join(files, spark):
    lines = corpus.split_lines(corpus.route_language(files(("/a.rs", "use time;\nuse serde::X;\n"))), "language")
    mine = spark.createDataFrame([("rust", "serde", "no serde", 0)], "language string, name string, suggestion string, rank int")
    found = line_rules.rule_banned_crate_usage(lines, mine).collect()
    assert [(r.line_num, r.fix_suggestion) for r in found] == [(2, "no serde")]


@pytest.mark.parametrize(
    "test, hits",
    [
        ("x is 1000", 1), ("x is 256", 0), ("x is 257", 1), ("x is -6", 0), ("x is 0.0", 0), ("x is 1.0", 0),
        ("x is 3.14", 1), ("x is ''", 1), ("x is 'hello'", 1), ("x is True", 0), ("x is None", 0), ("x is b'a'", 0),
        ("x is not 999", 1), ("x is 1e999", 1), ("a is 1000 is 2000", 2), ("x == 1000", 0), ("1000 is x", 0),
        ("x is 0x" + "f" * 4000, 1),
    ],
)
def test_identity(scan, test, hits):
    assert len(of_type(scan(("/a.py", DOC + f"y = {test}\n")), "identity_comparison_gotcha")) == hits


def test_no_false_positives_in_comments_and_strings(scan):
    text = DOC + "# print('x') compile(a, b) os.path.join(a)\ns = 'print(1) os.environ'\nobj.print(s)\nobj.compile(s, s)\nos.path\n"
    assert not set(kinds(scan(("/a.py", text)))) & {"debug_pattern", "security_violation", "path_handling", "environment_variable_handling"}


def test_path_traversal_arguments(scan):
    calls = ["os.path.join(a)", "os.path.join('a')", "os.path.join(f())", "os.path.join(d['k'])", "os.path.join(a + 'x')", "os.path.sep.join(a)"]
    text = DOC + "\n".join(calls) + "\n"
    assert of_type(scan(("/a.py", text)), "security_violation") == [(2, "error"), (4, "error"), (5, "error")]
    assert [line for line, _ in of_type(scan(("/a.py", text)), "path_handling")] == [2, 3, 4, 5, 6, 7]


def test_compile_needs_two_positional_arguments(scan):
    text = DOC + "compile(a)\ncompile(a, b)\ncompile(a, filename=b)\ncompile(*a, b)\n"
    assert of_type(scan(("/a.py", text)), "security_violation") == [(3, "warning"), (5, "warning")]


def test_mock_shapes(scan):
    text = DOC + "\n".join(
        [
            "@patch('a.b')", "@mock.patch('a.b')", "@unittest.patch('a.b')", "@patch.object(x, 'y')", "@mock.patch.object(x, 'y')",
            "@unittest.mock.patch('a.b')", "@patch(name)", "@patch('')", "@mock_patch('c')", "async def test_x(m):", '    """D."""',
            "    with patch('q'), mock.patch('r'):", "        MagicMock(); mock.Mock()", "    async with patch('s'):", "        pass",
            "@patch('on.class')", "class T:", '    """D."""',
        ]
    )
    lines = [line for line, _ in of_type(scan(("/p/tests/t.py", text)), "mock_violation")]
    assert lines == [2, 3, 4, 10, 13, 13, 14]
    assert not of_type(scan(("/p/service.py", text)), "mock_violation")


def test_docstrings(scan):
    text = "\n".join(
        ["def f():", "    def g(): pass", "    async def h(): pass", "class _P: pass", "class Q:", "    ''", "    def _m(self): pass", "def d():", "    ' x '"]
    )
    found = scan(("/a.py", text))
    assert [line for line, _ in of_type(found, "missing_docstring")] == [1, 2, 3, 5]
    assert of_type(found, "missing_module_docstring") == [(1, "warning")]


@pytest.mark.parametrize("doc, kind", [("''", "missing_module_docstring"), ("'  short  '", "inadequate_module_docstring"), ("'" + "x" * 20 + "'", None)])
def test_module_docstring(scan, doc, kind):
    got = [k for k in kinds(scan(("/a.py", doc + "\n"))) if k.endswith("module_docstring")]
    assert got == ([kind] if kind else [])


def test_dataclass_shapes(scan):
    def cls(name, *body):
        return [f"class {name}:", "    'D.'", *body]

    init = ["    def __init__(self, a, b):", "        self.a = a", "        self.b = b"]
    text = "\n".join(
        [
            *cls("Yes", *init),
            *cls("Call", "    def __init__(self, a, b):", "        self.a = a", "        f()"),
            *cls("One", "    def __init__(self, a):", "        self.a = a"),
            *cls("Async", "    async def __init__(self, a, b):", "        self.a = a"),
            *cls("Last", *init, "    def __init__(self, a):", "        f()"),
            *cls("Any", "    def __init__(self, a):", "        self.a = a", "    def __init__(self, a, b):", "        f()"),
        ]
    )
    assert [line for line, _ in of_type(scan(("/a.py", text)), "dataclass_opportunity")] == [1, 26]


def test_long_chain_reports_every_suffix(scan):
    chain = "if a == 0:\n    pass\n" + "".join(f"elif a == {i}:\n    pass\n" for i in range(1, 6)) + "else:\n    if b:\n        pass\n"
    assert [line for line, _ in of_type(scan(("/a.py", DOC + chain)), "match_case_opportunity")] == [2, 4, 6, 8]


def test_test_naming(scan):
    text = DOC + "def helper(): 'd'\ndef _x(): 'd'\ndef test_a(): 'd'\nclass T:\n    'd'\n    def inner(self): 'd'\ndef\ttabbed(): 'd'\n"
    assert of_type(scan(("/p/tests/a.py", text)), "test_naming_convention") == [(2, "warning")]
    assert not of_type(scan(("/p/a.py", text)), "test_naming_convention")


def test_typescript_imports(scan):
    text = "import a from 'moment/locale'\n  import {b} from \"axios\";\nimport 'lodash'\nconst x = require('axios')\nimport c from 'momentum'\nimport {\n} from 'request'\n"
    assert of_type(scan(("/a.tsx", text)), "banned_package_import") == [(1, "error"), (2, "error")]


def test_rust_and_go(scan):
    assert scan(("/a.rs", "use time;\nuse timer;\npub use rand;\nuse error-chain;\n// use rand\n")) == [("banned_crate_usage", 1, "error")]
    go = 'import "io/ioutil"\nimport ("io/ioutil")\nx, _ := f()\n_ = f()\nrecover(); panic (x)\nnopanic(x)\nimport "github.com/pkg/errors/x"\n'
    assert scan(("/a.go", go)) == [("banned_package_usage", 1, "error"), ("error_ignoring", 3, "warning"), ("panic_abuse", 5, "error")]


def test_old_formatting_is_linear_and_equal(files):
    import re

    texts = ["'%s'", "'a' % s", "x %s 'y'", "\"%d' z", "'a\n%s'", "a'%d", "'x' %s \"y\" %d", "'" * 50, "%s''%s'"]
    found = file_rules.rule_old_formatting(corpus.route_language(files(*[(f"/{i}.py", t) for i, t in enumerate(texts)])))
    got = {int(r.path[1:-3]) for r in found.collect()}
    assert got == {i for i, t in enumerate(texts) if re.search(r"[\"'].*%[sd].*[\"']", t)}
    hostile = "'" * 200_000 + "%s" * 100_000
    assert file_rules.rule_old_formatting(corpus.route_language(files(("/h.py", hostile)))).count() == 0


def test_composition(scan):
    one = "class A(B):\n    def f(self):\n        super().f()\n"
    assert "composition_violation" in kinds(scan(("/a.py", one)))
    assert "composition_violation" not in kinds(scan(("/a.py", one + "class C:\n    pass\n")))
    assert "composition_violation" not in kinds(scan(("/a.py", "class \nsuper()\n")))


def test_duplicates_stay(scan):
    assert len(of_type(scan(("/a.py", DOC + "print(1); print(2)\n")), "debug_pattern")) == 2


def test_syntax_error_keeps_text_rules(scan):
    found = scan(("/a.py", "import threading\nprint((\n"))
    assert found == [("antipattern", 1, "warning")]


def test_odd_sources(scan):
    assert scan(("/a.py", DOC + "s = '\\ud800' is '\\ud800'\n")) == [("identity_comparison_gotcha", 2, "error")]
    assert scan(("/a.py", "\ufeff" + DOC)) == []
    assert scan(("/a.py", "   \n\t\n")) == []
    crlf = DOC.replace("\n", "\r\n") + "import threading\r\n"
    assert scan(("/a.py", crlf)) == [("antipattern", 2, "warning"), ("gil_confusion", 2, "warning")]
    assert scan(("/a.py", DOC + "y = " + "-" * 20000 + "1\n")) == [("analysis_error", 0, "warning")]
    form_feed = DOC + "x = 1\x0cimport threading\n"
    assert [line for line, _ in of_type(scan(("/a.py", form_feed)), "antipattern")] == [3]


def test_routing(files):
    paths = ["/a.py", "/a.PY", "/a.ts", "/a.jsx", "/a.rs", "/a.go", "/a.txt", "/a.md", "/a.json", "/.py", "/a"]
    routed = corpus.route_language(files(*[(p, "x") for p in paths]))
    assert sorted(r.path for r in routed.collect()) == ["/a.go", "/a.jsx", "/a.py", "/a.rs", "/a.ts"]
    assert corpus.route_language(files(("/a.PY", "x")), strict_case=False).count() == 1


def test_user_pack(files):
    registry = PackRegistry()
    registry.register("lua", [".lua"], [LineRule("no_goto", "lua", r"\bgoto\s+(\w+)", "error", "goto {name}", group=1)])
    found = registry.scan(files(("/a.lua", "x = 1\ngoto done\n"), ("/b.rs", "use rand;\n"))).collect()
    assert {(r.language, r.violation_type, r.message) for r in found} == {
        ("lua", "no_goto", "goto done"),
        ("rust", "banned_crate_usage", "Banned crate 'rand'"),
    }


# Plans


def test_scan_reads_once_parses_once_and_does_not_shuffle(files, plan):
    text = plan(scan_all(files(("/a.py", "import os\n"))))
    tree = text.split("\n\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1
    assert "Exchange" not in tree


def test_filter_on_decisions_does_not_copy_the_rules(files, plan):
    from lintlake.plans.scan import scan_decisions

    tree = plan(scan_decisions(files(("/a.py", "import os\n"))).filter("decision = 'block'")).split("\n\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1


def test_patterns_stay_linear_on_long_lines(spark):
    import time

    from pyspark.sql import functions as F

    from lintlake.operators.rulebook import LINE_RULES
    from workloads.corpus_queries import TEXT_PACK

    n = 1_000_000
    lines = [" " * n, "a" * n, "'" * n, "(" * n, "import " + " " * n + "x", "import" + " from" * (n // 5), "def f(" * (n // 6), "a@" * (n // 2)]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    start = time.monotonic()
    table.select(*[F.col("line").rlike(rule.pattern).alias(f"r{i}") for i, rule in enumerate([*LINE_RULES, *TEXT_PACK])]).collect()
    assert time.monotonic() - start < 60
