"""Rules over syntax facts, held as data.

A rule is a few SQL expressions over one fact (``fact``, a struct) and the file it is in
(``path``, ``test_strict``, ``test_loose``).  The same text runs inside the per-file scan,
where ``fact`` is an array element, and over the flat facts table, where it is a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.findings import NO_FINDINGS_SQL, SYNTAX, explode_findings, finding_sql
from lintlake.functions.joins import salted_join
from lintlake.functions.text import quoted
from lintlake.operators.facts import Needed, fact_struct
from lintlake.operators.rulebook import (
    ALLOWED_IN_TESTS,
    BANNED_NAMES,
    MOCK_CALLS,
    MOCK_CONSTRUCTORS,
    NEVER_BANNED,
    UNITTEST_IN_TESTS,
)


@dataclass(frozen=True)
class FactRule:
    """Fires on facts of ``kinds`` when ``when`` holds; all texts but the first are SQL.

    With ``each``, an array, the rule gives one finding per element, called ``item``.
    ``roots`` are the first names of the calls, attributes, decorators or with-items it asks
    about ("os" for os.path.join); a rule that names none is shown all of them.
    """

    violation_type: str
    severity: str
    kinds: tuple[str, ...]
    when: str
    message: str
    fix: str = "''"
    context: dict[str, str] = field(default_factory=dict)
    line: str = "fact.lineno"
    each: str = ""
    roots: tuple[str, ...] = ()


def _in(name: str, values: list[str]) -> str:
    return f"{name} IN ({', '.join(map(quoted, values))})"


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quoted(key)}, {value}" for key, value in pairs.items()) + ")"


# os.path.<attribute>, written out, with nothing before or after it.
_OS_PATH_ATTRIBUTE = r"fact.name RLIKE '^os\\.path\\.[^.]+$'"
_PREFIXES = r"transform(split(fact.name, '\\.'), (p, i) -> array_join(slice(split(fact.name, '\\.'), 1, i + 1), '.'))"

_NAMES = BANNED_NAMES["python"]
_RANKS = _map({name: str(rank) for rank, name in enumerate(_NAMES)})
_ADVICE = _map({name: quoted(advice) for name, advice in _NAMES.items()})
# The first table entry that equals the imported name or is a dotted prefix of it.
_BANNED_RANK = f"array_min(transform({_PREFIXES}, p -> try_element_at({_RANKS}, p)))"
_BANNED_NAME = f"try_element_at(array({', '.join(map(quoted, _NAMES))}), {_BANNED_RANK} + 1)"
_HEADS = sorted({name.split(".")[0] for name in _NAMES})

_INITS = "filter(fact.members, m -> m.kind = 'method' AND m.name = '__init__' AND m.n_params > 1)"
_INIT_PARAMS = f"try_element_at({_INITS}, -1).n_params"
_TEXT_CONSTANTS = "size(filter(fact.members, m -> m.kind = 'assign' AND m.const_type = 'str'))"

# Literals carry no sign, so "above 256" is the whole test of an integer.
_BIG_INT = "(fact.const_type = 'int' AND (length(fact.const_value) > 3 OR try_cast(fact.const_value AS INT) > 256))"
_ODD_FLOAT = "(fact.const_type = 'float' AND try_cast(fact.const_value AS DOUBLE) NOT IN (0.0D, 1.0D))"
_LITERAL = f"CASE WHEN {_BIG_INT} THEN 'integer' WHEN {_ODD_FLOAT} THEN 'float' ELSE 'string' END"

_IS_MOCK_OBJECT = f"(fact.kind = 'call' AND {_in('fact.name', MOCK_CONSTRUCTORS)})"
_IS_PATCH = f"(fact.kind <> 'call' AND {_in('fact.name', MOCK_CALLS)} AND fact.const_truthy)"
_MOCK_TARGET = f"CASE WHEN {_IS_MOCK_OBJECT} THEN fact.name ELSE fact.const_value END"

gil_confusion = FactRule(
    "gil_confusion",
    "warning",
    ("import",),
    "fact.name = 'threading'",
    quoted("Threads do not run Python code in parallel"),
    quoted("Use multiprocessing for computing, asyncio for waiting"),
    {"pattern": "'threading_import'", "import_name": "fact.name"},
)
local_directory_import = FactRule(
    "local_directory_import",
    "warning",
    ("import",),
    "contains(fact.name, '.') AND NOT startswith(fact.name, '.')",
    "concat('Import of ', fact.name, ' may depend on the working directory')",
    quoted("Run with -m or use a src layout"),
    {"pattern": "'local_import'", "import_name": "fact.name"},
)
banned_import = FactRule(
    "banned_import",
    "error",
    ("import", "import_from"),
    f"{_in('substring_index(fact.name, chr(46), 1)', _HEADS)} AND NOT {_in('fact.name', NEVER_BANNED)} "
    f"AND NOT (test_loose AND {_in('fact.name', ALLOWED_IN_TESTS)}) AND {_BANNED_RANK} IS NOT NULL",
    "concat('Banned import ', fact.name)",
    f"CASE WHEN test_loose AND fact.name = 'unittest' THEN {quoted(UNITTEST_IN_TESTS)} "
    f"ELSE try_element_at({_ADVICE}, {_BANNED_NAME}) END",
    {"import_name": "fact.name", "banned_module": _BANNED_NAME, "is_test_file": "test_loose"},
)
missing_function_docstring = FactRule(
    "missing_docstring",
    "warning",
    ("function",),
    "fact.doc_len IS NULL AND NOT startswith(fact.name, '_')",
    "concat('Function ', fact.name, ' has no docstring')",
    quoted("Describe arguments, result and exceptions"),
    {"pattern": "'missing_function_docstring'", "function_name": "fact.name", "is_public": "true"},
)
missing_class_docstring = FactRule(
    "missing_docstring",
    "warning",
    ("class",),
    "fact.doc_len IS NULL AND NOT startswith(fact.name, '_')",
    "concat('Class ', fact.name, ' has no docstring')",
    quoted("Describe what the class is for"),
    {"pattern": "'missing_class_docstring'", "class_name": "fact.name", "is_public": "true"},
)
missing_module_docstring = FactRule(
    "missing_module_docstring",
    "warning",
    ("module",),
    "fact.doc_len IS NULL",
    quoted("Module has no docstring"),
    quoted("Say at the top what the module does"),
    {"pattern": "'missing_module_docstring'", "file_type": "'module'"},
)
# Fixed value: a module docstring needs 20 characters.
inadequate_module_docstring = FactRule(
    "inadequate_module_docstring",
    "warning",
    ("module",),
    "fact.doc_len < 20",
    quoted("Module docstring is shorter than 20 characters"),
    quoted("Say more about what the module does"),
    {"pattern": "'brief_module_docstring'", "docstring_length": "fact.doc_len"},
)
# A plain attribute-setting __init__; the last one in the class gives the parameter count.
dataclass_opportunity = FactRule(
    "dataclass_opportunity",
    "warning",
    ("class",),
    f"exists({_INITS}, m -> m.only_self_assigns) AND {_INIT_PARAMS} >= 3",
    "concat('Class ', fact.name, ' could be a dataclass')",
    quoted("Declare the attributes with @dataclass"),
    {"pattern": "'manual_init_class'", "class_name": "fact.name", "param_count": f"{_INIT_PARAMS} - 1"},
)
enum_opportunity = FactRule(
    "enum_opportunity",
    "warning",
    ("class",),
    f"{_TEXT_CONSTANTS} >= 3",
    f"concat('Class ', fact.name, ' holds ', {_TEXT_CONSTANTS}, ' text constants')",
    quoted("Make it an enum.Enum"),
    {"pattern": "'string_constants_class'", "class_name": "fact.name", "constant_count": _TEXT_CONSTANTS},
)
# One finding per branch that three or more elifs still follow.
match_case_opportunity = FactRule(
    "match_case_opportunity",
    "warning",
    ("if_chain",),
    "size(fact.branch_lines) >= 4",
    "concat('if/elif chain of ', item.conditions, ' conditions')",
    quoted("Use match/case"),
    {"pattern": "'long_if_elif_chain'", "condition_count": "item.conditions"},
    line="item.line",
    each="transform(slice(fact.branch_lines, 1, size(fact.branch_lines) - 3), "
    "(line, i) -> named_struct('line', line, 'conditions', size(fact.branch_lines) - i))",
)
# ``is`` against a number or text whose identity is an accident.
identity_comparison_gotcha = FactRule(
    "identity_comparison_gotcha",
    "error",
    ("identity_test",),
    f"{_BIG_INT} OR {_ODD_FLOAT} OR fact.const_type = 'str'",
    f"CASE WHEN {_BIG_INT} THEN concat('Identity test against the integer ', fact.const_value) "
    f"ELSE concat('Identity test against a ', {_LITERAL}) END",
    quoted("Compare values with ==; keep 'is' for None, True and False"),
    {
        "pattern": f"concat({_LITERAL}, '_identity_comparison')",
        "value": f"CASE WHEN {_BIG_INT} THEN fact.const_value ELSE fact.const_value END",
    },
)
compile_call = FactRule(
    "security_violation",
    "warning",
    ("call",),
    "fact.name = 'compile' AND fact.n_args >= 2",
    quoted("compile() turns text into code"),
    quoted("Parse with ast.parse, or check the text first"),
    {"pattern": "'compile_usage'", "function": "'compile'"},
    roots=("compile",),
)
path_traversal = FactRule(
    "security_violation",
    "error",
    ("call",),
    f"{_OS_PATH_ATTRIBUTE} AND arrays_overlap(fact.arg_kinds, array('Name', 'Call', 'Subscript'))",
    quoted("File path built from a variable may leave its directory"),
    quoted("Resolve the path and check it against the allowed directories"),
    {"pattern": "'path_traversal_risk'", "method": "fact.name"},
    roots=("os",),
)
path_handling = FactRule(
    "path_handling",
    "warning",
    ("attribute",),
    _OS_PATH_ATTRIBUTE,
    quoted("os.path in place of pathlib"),
    quoted("Import Path from pathlib"),
    {"pattern": "'os_path_usage'", "method": "substring_index(fact.name, '.', -1)"},
    roots=("os",),
)
environment_variable_handling = FactRule(
    "environment_variable_handling",
    "warning",
    ("attribute",),
    "fact.name = 'os.environ'",
    quoted("os.environ used directly"),
    quoted("Call os.getenv with a default"),
    {"pattern": "'os_environ_direct_access'"},
    roots=("os",),
)
debug_pattern = FactRule(
    "debug_pattern",
    "warning",
    ("call",),
    "fact.name = 'print'",
    quoted("print() left in the code"),
    quoted("Use a logger, or rich.print"),
    {"pattern": "'print_usage'", "function": "'print'"},
    roots=("print",),
)
# Patches with a literal target and mock objects, in test files.
mock_violation = FactRule(
    "mock_violation",
    "error",
    ("decorator", "with_item", "call"),
    f"test_strict AND ({_IS_PATCH} OR {_IS_MOCK_OBJECT})",
    f"concat('Mock of ', {_MOCK_TARGET})",
    f"concat('Wrap the dependency and test the wrapper, or allow ', {_MOCK_TARGET}, ' in the project configuration')",
    {
        "pattern": "'mock_detection'",
        "mock_type": "CASE fact.kind WHEN 'decorator' THEN 'decorator' WHEN 'with_item' THEN 'context_manager' "
        "ELSE 'constructor' END",
        "mock_target": _MOCK_TARGET,
    },
    roots=tuple(sorted({name.split(".")[0] for name in [*MOCK_CALLS, *MOCK_CONSTRUCTORS]})),
)
# A file whose syntax tree could not be built for another reason than its syntax.
analysis_error = FactRule(
    "analysis_error", "warning", ("failure",), "true", "concat('Analysis failed: ', fact.name)"
)

FACT_RULES: list[FactRule] = [
    missing_module_docstring,
    inadequate_module_docstring,
    gil_confusion,
    local_directory_import,
    banned_import,
    missing_function_docstring,
    missing_class_docstring,
    dataclass_opportunity,
    enum_opportunity,
    match_case_opportunity,
    identity_comparison_gotcha,
    compile_call,
    mock_violation,
    debug_pattern,
    path_traversal,
    path_handling,
    environment_variable_handling,
    analysis_error,
]


# Kinds of facts that carry the name of something called or read.
_NAMED = ("call", "attribute", "decorator", "with_item")


def needed_facts(rules: list[FactRule] | None = None) -> Needed:
    """What the rules look at: the kinds and, for calls and the like, the first names."""
    needed: Needed = {}
    for rule in FACT_RULES if rules is None else rules:
        for kind in rule.kinds:
            if kind not in _NAMED or not rule.roots or needed.get(kind, frozenset()) is None:
                needed[kind] = None
            else:
                needed[kind] = needed.get(kind, frozenset()) | frozenset(rule.roots)
    return needed


def _findings_sql(rule: FactRule, rank: int) -> str:
    order = f"{SYNTAX} * 10000000000 + fact.node_id * 100 + {rank}"
    row = finding_sql(
        rule.line, quoted(rule.violation_type), quoted(rule.severity), rule.message, rule.fix, rule.context, order
    )
    rows = f"transform({rule.each}, item -> {row})" if rule.each else f"array({row})"
    return f"CASE WHEN {rule.when} THEN {rows} ELSE {NO_FINDINGS_SQL} END"


def findings_of_fact_sql(rules: list[FactRule]) -> str:
    """SQL text: the findings of one fact; it is only shown to the rules of its kind."""
    by_kind: dict[str, list[str]] = {}
    for position, rule in enumerate(rules):
        rank = FACT_RULES.index(rule) if rule in FACT_RULES else len(FACT_RULES) + position
        for kind in rule.kinds:
            by_kind.setdefault(kind, []).append(_findings_sql(rule, rank))
    branches = " ".join(
        f"WHEN {quoted(kind)} THEN " + (f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])
        for kind, parts in by_kind.items()
    )
    return f"CASE fact.kind {branches} ELSE {NO_FINDINGS_SQL} END" if branches else NO_FINDINGS_SQL


def with_test_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("test_strict", P.is_test_strict(F.col("path"))).withColumn(
        "test_loose", P.is_test_loose(F.col("path"))
    )


def fact_findings(rules: list[FactRule] | None = None) -> Column:
    """ARRAY of findings on one file with columns facts, test_strict and test_loose."""
    return F.expr(f"flatten(transform(facts, fact -> {findings_of_fact_sql(FACT_RULES if rules is None else rules)}))")


def apply_fact_rules(facts: DataFrame, *rules: FactRule) -> DataFrame:
    """Findings of the given rules (default: all) over the flat facts table."""
    chosen = list(rules) or FACT_RULES
    kinds = sorted({kind for rule in chosen for kind in rule.kinds})
    shown = facts.filter(F.col("kind").isin(kinds)).select("path", F.lit("python").alias("language"), fact_struct().alias("fact"))
    return explode_findings(with_test_flags(shown), F.expr(findings_of_fact_sql(chosen)))


def _first_banned(named: DataFrame, table: DataFrame) -> DataFrame:
    """(path, test_loose, fact, first): the first table entry that is a dotted beginning of each fact's name.

    An equi-join on all beginnings of a name, so a table of thousands of names is never searched.
    Spark broadcasts the table only below its size threshold, and the names are
    salted, because a popular one may be everywhere.
    """
    fact = F.struct("node_id", "lineno", "name").alias("fact")
    candidates = named.select("path", "test_loose", fact).withColumn("prefix", F.explode(F.expr(_PREFIXES)))
    entries = table.select(F.col("name").alias("prefix"), "rank", "suggestion")
    matched = salted_join(candidates, entries, ["prefix"])
    return matched.groupBy("path", "test_loose", "fact").agg(F.min(F.struct("rank", "prefix", "suggestion")).alias("first"))


def rule_banned_import(facts: DataFrame, banned_names: DataFrame | None = None) -> DataFrame:
    """Banned imports; with a table (language, name, suggestion, rank) given, a join on the dotted prefixes."""
    if banned_names is None:
        return apply_fact_rules(facts, banned_import)
    imports = with_test_flags(facts.filter(F.col("kind").isin("import", "import_from")))
    imports = imports.filter(
        ~F.col("name").isin(NEVER_BANNED) & ~(F.col("test_loose") & F.col("name").isin(ALLOWED_IN_TESTS))
    )
    first = _first_banned(imports, banned_names.filter(F.col("language") == "python"))
    row = finding_sql(
        "fact.lineno",
        quoted(banned_import.violation_type),
        quoted(banned_import.severity),
        banned_import.message,
        f"CASE WHEN test_loose AND fact.name = 'unittest' THEN {quoted(UNITTEST_IN_TESTS)} ELSE first.suggestion END",
        {"import_name": "fact.name", "banned_module": "first.prefix", "is_test_file": "test_loose"},
        f"{SYNTAX} * 10000000000 + fact.node_id * 100 + {FACT_RULES.index(banned_import)}",
    )
    return explode_findings(first.withColumn("language", F.lit("python")), F.expr(f"array({row})"))


def rule_banned_call(facts: DataFrame, banned_names: DataFrame, severity: str = "error") -> DataFrame:
    """Calls of names in a table (name, suggestion, rank): the name itself or anything below it.

    ``pickle`` in the table bans ``pickle.loads(x)``.  Of several entries the one of lowest rank counts.
    """
    calls = with_test_flags(facts.filter((F.col("kind") == "call") & F.col("name").isNotNull()))
    row = finding_sql(
        "fact.lineno",
        "'banned_call'",
        quoted(severity),
        "concat('Banned call ', fact.name)",
        "coalesce(first.suggestion, '')",
        {"call": "fact.name", "banned_name": "first.prefix"},
        f"{SYNTAX} * 10000000000 + fact.node_id * 100 + {len(FACT_RULES)}",
    )
    return explode_findings(_first_banned(calls, banned_names).withColumn("language", F.lit("python")), F.expr(f"array({row})"))


def chain_lengths(facts: DataFrame) -> DataFrame:
    """(path, lineno, n_following): for every branch of a chain, how many elifs follow it."""
    chains = facts.filter(F.col("kind") == "if_chain").select(
        "path", F.size("branch_lines").alias("n"), F.posexplode("branch_lines").alias("pos", "lineno")
    )
    return chains.select("path", "lineno", (F.col("n") - F.col("pos") - 1).alias("n_following"))
