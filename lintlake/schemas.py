"""Column layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# One finding inside a per-file array; ``path`` and ``language`` are added when it is exploded.
FINDING = T.StructType(
    [
        T.StructField("line_num", T.IntegerType()),
        T.StructField("violation_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fix_suggestion", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("language_context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("rule_order", T.LongType()),
    ]
)
FINDINGS = T.ArrayType(FINDING)

VIOLATION_COLUMNS = ["path", "language", *FINDING.fieldNames()]

HISTORY = T.StructType(
    [
        T.StructField("project_hash", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("line_num", T.IntegerType(), False),
        T.StructField("violation_type", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("fix_suggestion", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)
HISTORY_COLUMNS = HISTORY.fieldNames()

# Two rows with equal values here are the same finding; the later one wins.
HISTORY_KEY = ["project_hash", "file_path", "line_num", "violation_type", "message"]

FACT_MEMBER = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("n_params", T.IntegerType()),
        T.StructField("only_self_assigns", T.BooleanType()),
        T.StructField("const_type", T.StringType()),
    ]
)

# One syntax fact of a Python file.  Which columns are filled depends on ``kind``.
FACT = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("n_args", T.IntegerType()),
        T.StructField("arg_kinds", T.ArrayType(T.StringType())),
        T.StructField("const_type", T.StringType()),
        T.StructField("const_value", T.StringType()),
        T.StructField("const_truthy", T.BooleanType()),
        T.StructField("doc_len", T.IntegerType()),
        T.StructField("members", T.ArrayType(FACT_MEMBER)),
        T.StructField("branch_lines", T.ArrayType(T.IntegerType())),
    ]
)
FACTS = T.ArrayType(FACT)
