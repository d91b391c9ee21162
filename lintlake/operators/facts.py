"""Syntax facts of Python files: the only step that leaves the JVM.

``py_facts`` makes an Arrow UDF from text to ARRAY<fact>.  It parses with the standard library
and writes down what is there; it decides nothing.  Every rule is a column expression over
the facts (see ``fact_rules``).  One source file gives one array, so rules that look at a
whole class or a whole if/elif chain need no shuffle, and the step also runs on a stream.

A scan hands in what its rules need (see ``fact_rules.needed_facts``), so facts that no rule
looks at never leave the parser; without that, all facts are written down.
"""

from __future__ import annotations

import ast
import gc
import sys
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lintlake.schemas import FACTS

# Which facts are wanted: per kind all (None) or those whose name starts with one of some first
# names ("os" for os.path.join).  Kinds that are not listed are left out; no table wants all.
Needed = dict[str, frozenset[str] | None]


def _dotted(node: ast.AST) -> str | None:
    """The dotted name of a call or attribute; on anything but a name, it starts with a dot."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(names)])
    return ".".join(["", *reversed(names)]) if names else None


def _clean(text: str) -> str:
    """Lone surrogates are legal in a literal but not in Arrow text."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _constant(node: ast.AST | None) -> dict:
    if not isinstance(node, ast.Constant):
        return {}
    value = node.value
    try:
        shown = str(value)
    except ValueError:  # a hexadecimal integer with thousands of digits
        shown = hex(value)
    return {"const_type": type(value).__name__, "const_value": _clean(shown), "const_truthy": bool(value)}


def _doc_len(node: ast.AST) -> int | None:
    doc = ast.get_docstring(node)
    return len(doc.strip()) if doc else None


def _sets_self_attribute(stmt: ast.stmt) -> bool:
    if not isinstance(stmt, ast.Assign) or len(stmt.targets) != 1:
        return False
    target = stmt.targets[0]
    return isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self"


def _members(node: ast.ClassDef) -> list[dict]:
    members = []
    for stmt in node.body:
        if isinstance(stmt, ast.FunctionDef):
            members.append(
                {
                    "kind": "method",
                    "name": stmt.name,
                    "n_params": len(stmt.args.args),
                    "only_self_assigns": all(map(_sets_self_attribute, stmt.body)),
                }
            )
        elif isinstance(stmt, ast.Assign) and len(stmt.targets) == 1 and isinstance(stmt.targets[0], ast.Name):
            members.append({"kind": "assign", "name": stmt.targets[0].id, **_member_type(stmt.value)})
    return members


def _member_type(value: ast.expr) -> dict:
    return {"const_type": type(value.value).__name__} if isinstance(value, ast.Constant) else {}


def _call(node: ast.Call) -> dict:
    first = node.args[0] if node.args else None
    return {
        "name": _dotted(node.func),
        "n_args": len(node.args),
        "arg_kinds": [type(arg).__name__ for arg in node.args],
        **_constant(first),
    }


# One function per kind of syntax node; the node types without one carry no facts.


def _module(node: ast.Module, seen: set[int]) -> list[dict]:
    return [{"kind": "module", "lineno": 1, "doc_len": _doc_len(node)}]


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, seen: set[int]) -> list[dict]:
    calls = [deco for deco in node.decorator_list if isinstance(deco, ast.Call)]
    facts = [{"kind": "decorator", "lineno": c.lineno, **_call(c)} for c in calls]
    return facts + [{"kind": "function", "lineno": node.lineno, "name": node.name, "doc_len": _doc_len(node)}]


def _class(node: ast.ClassDef, seen: set[int]) -> list[dict]:
    fact = {"kind": "class", "lineno": node.lineno, "name": node.name, "doc_len": _doc_len(node)}
    return [{**fact, "members": _members(node)}]


def _import(node: ast.Import, seen: set[int]) -> list[dict]:
    return [{"kind": "import", "lineno": node.lineno, "name": alias.name} for alias in node.names]


def _import_from(node: ast.ImportFrom, seen: set[int]) -> list[dict]:
    fact = {"kind": "import_from", "lineno": node.lineno, "name": node.module, "n_args": node.level}
    return [fact] if node.module else []


def _with(node: ast.With, seen: set[int]) -> list[dict]:
    calls = [item.context_expr for item in node.items if isinstance(item.context_expr, ast.Call)]
    return [{"kind": "with_item", "lineno": node.lineno, **_call(c)} for c in calls]


def _if(node: ast.If, seen: set[int]) -> list[dict]:
    """The chain that starts here; its elifs are remembered and start none of their own."""
    if id(node) in seen:
        return []
    lines = [node.lineno]
    branch = node
    while len(branch.orelse) == 1 and isinstance(branch.orelse[0], ast.If):
        branch = branch.orelse[0]
        seen.add(id(branch))
        lines.append(branch.lineno)
    return [{"kind": "if_chain", "lineno": node.lineno, "branch_lines": lines}] if len(lines) > 1 else []


def _compare(node: ast.Compare, seen: set[int]) -> list[dict]:
    return [
        {"kind": "identity_test", "lineno": node.lineno, **_constant(right)}
        for op, right in zip(node.ops, node.comparators)
        if isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant)
    ]


def _named_call(node: ast.Call, seen: set[int]) -> list[dict]:
    return [{"kind": "call", "lineno": node.lineno, **_call(node)}]


def _attribute(node: ast.Attribute, seen: set[int]) -> list[dict]:
    return [{"kind": "attribute", "lineno": node.lineno, "name": _dotted(node)}]


FACTS_BY_NODE = {
    ast.Module: _module,
    ast.FunctionDef: _function,
    ast.AsyncFunctionDef: _function,
    ast.ClassDef: _class,
    ast.Import: _import,
    ast.ImportFrom: _import_from,
    ast.With: _with,
    ast.If: _if,
    ast.Compare: _compare,
    ast.Call: _named_call,
    ast.Attribute: _attribute,
}

# Fields that hold no nodes, or only operators and contexts, and node types that are leaves.
_PLAIN_FIELDS = frozenset({"ctx", "op", "ops", "id", "attr", "level", "module", "type_comment", "is_async", "simple", "kind"})
_LEAVES = (ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)


def _children(node: ast.AST) -> list[ast.AST]:
    children: list[ast.AST] = []
    for field in node._fields:
        if field not in _PLAIN_FIELDS:
            value = getattr(node, field, None)
            for child in value if isinstance(value, list) else (value,):
                if isinstance(child, ast.AST) and not isinstance(child, _LEAVES):
                    children.append(child)
    return children


# The kinds of facts each function writes down, and how to tell before building a fact that
# nobody asked for its name.
_KINDS = {
    _module: ("module",),
    _function: ("decorator", "function"),
    _class: ("class",),
    _import: ("import",),
    _import_from: ("import_from",),
    _with: ("with_item",),
    _if: ("if_chain",),
    _compare: ("identity_test",),
    _named_call: ("call",),
    _attribute: ("attribute",),
}


def _root(node: ast.AST) -> str:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else ""


def _wanted(fact: dict, needed: Needed) -> bool:
    if fact["kind"] not in needed:
        return False
    roots = needed[fact["kind"]]
    return roots is None or (fact.get("name") or "").split(".", 1)[0] in roots


def _functions(needed: Needed | None) -> dict:
    """The functions to call per node type, only for kinds that are wanted."""
    if needed is None:
        return FACTS_BY_NODE
    return {node: found for node, found in FACTS_BY_NODE.items() if any(kind in needed for kind in _KINDS[found])}


def facts_of_text(text: str | None, needed: Needed | None = None) -> list[dict] | None:
    """Facts in source order; none for a syntax error; one ``failure`` fact for a crash."""
    if text is None:
        return None
    facts: list[dict] = []
    functions = _functions(needed)
    call_roots, attribute_roots = ((needed or {}).get(kind) for kind in ("call", "attribute"))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            stack: list[ast.AST] = [ast.parse(text)]
        seen: set[int] = set()
        while stack:
            node = stack.pop()
            found = functions.get(type(node))
            # Most nodes of a file are calls and attributes: look at the name before building the fact.
            if found is _named_call and call_roots is not None and _root(node.func) not in call_roots:
                found = None
            elif found is _attribute and attribute_roots is not None and _root(node) not in attribute_roots:
                found = None
            if found is not None:
                facts += found(node, seen) if needed is None else [f for f in found(node, seen) if _wanted(f, needed)]
            stack += reversed(_children(node))
    except SyntaxError:
        return []
    except (ValueError, RecursionError, MemoryError) as error:
        facts = [{"kind": "failure", "lineno": 0, "name": type(error).__name__}]
    for position, fact in enumerate(facts):
        fact["node_id"] = position
    return facts


_ARROW_FACTS = to_arrow_type(FACTS)

# The helpers above travel with the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def py_facts(needed: Needed | None = None):
    """The Arrow UDF that writes down the wanted facts of a text."""

    @F.arrow_udf(FACTS)
    def run(text: pa.Array) -> pa.Array:
        # Trees hold no cycles, so reference counting frees each one before the next is built, and
        # the cycle collector, which would walk every new node, can rest.
        gc.disable()
        try:
            return pa.array((facts_of_text(value.as_py(), needed) for value in text), type=_ARROW_FACTS)
        finally:
            gc.enable()

    return run


def with_facts(files: DataFrame, needed: Needed | None = None) -> DataFrame:
    """Adds ``facts``; null for other languages, whose text never crosses to Python."""
    return files.withColumn("facts", py_facts(needed)(F.when(F.col("language") == "python", F.col("text"))))


def extract_py_facts(files: DataFrame, needed: Needed | None = None) -> DataFrame:
    """Flat table: one row per fact of each Python file, all of them unless ``needed`` says which."""
    python = files.filter(F.col("language") == "python")
    return with_facts(python, needed).select("path", F.inline_outer("facts")).filter(F.col("kind").isNotNull())


def fact_struct() -> Column:
    """The fact columns of a flat facts table as one struct."""
    return F.struct(*[F.col(name) for name in FACTS.elementType.fieldNames()])
