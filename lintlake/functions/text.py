"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where Python's str.splitlines() ends a line.  One character class, which the
# regex engine tests quickly, and the LF of a CRLF.
LINE_BREAKS = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?+"
# Characters Python's str.strip() removes, for use with (?U).
BLANK = r"[\s\x1C-\x1F]"

# Blanks at both ends.  A run inside the text is looked at once, from its start.
OUTER_BLANKS = rf"(?U)^{BLANK}++|(?<!{BLANK}){BLANK}++\z"

# Python regexes know Unicode word characters, and their dot stops at LF only.
PY_FLAGS = "(?U)(?d)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def py_regex(pattern: str) -> str:
    """The Java spelling of a Python ``re`` pattern written without flags."""
    return PY_FLAGS + pattern


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_BLANKS, "")


def py_strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(OUTER_BLANKS)}, '')"


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1C-\x1F]")


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF; texts without CR are passed on untouched."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def line_array_sql(text: str) -> str:
    """SQL text: lines as ``str.splitlines()`` gives them, no empty line after a final break."""
    whole = "CASE WHEN element_at(parts, -1) = '' THEN slice(parts, 1, size(parts) - 1) ELSE parts END"
    return let_sql(f"split({text}, {quoted(LINE_BREAKS)}, -1)", "parts", whole)


def line_array(text: str) -> Column:
    return F.expr(line_array_sql(text))


def line_count(text: Column) -> Column:
    """Lines as text-mode iteration counts them (LF, CR and CRLF only)."""
    normal = normalize_newlines(text)
    breaks = F.length(normal) - F.length(F.replace(normal, F.lit("\n"), F.lit("")))
    tail = F.when((normal == "") | normal.endswith("\n"), 0).otherwise(1)
    return breaks + tail


def glob_to_regex(glob: Column) -> Column:
    """Shell glob (``*``, ``?``, ``[seq]``, ``[!seq]``) to a regex for the whole string.

    A bracket that never closes stands for itself; a backwards range matches nothing.
    """

    def one_set(token: Column) -> Column:
        negated = token.startswith("[!")
        start = F.when(negated, 3).otherwise(2)
        body = F.substring(token, start, F.length(token) - start)
        items = F.filter(
            F.regexp_extract_all(body, F.lit("(?s)(.-.|.)"), F.lit(1)),
            lambda item: (F.length(item) < 3) | (F.substring(item, 1, 1) <= F.substring(item, 3, 1)),
        )
        safe = F.transform(items, lambda item: F.regexp_replace(item, r"([\[\]\\^&])", r"\\$1"))
        text = F.array_join(safe, "")
        return F.when(text == "", F.when(negated, ".").otherwise("(?!)")).otherwise(
            F.concat(F.when(negated, "[^").otherwise("["), text, F.lit("]"))
        )

    def one_token(token: Column) -> Column:
        return (
            F.when(token == "*", ".*")
            .when(token == "?", ".")
            .when(token.startswith("[") & (F.length(token) > 1), one_set(token))
            .otherwise(F.regexp_replace(token, r"([^\w\s])", r"\\$1"))
        )

    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\[!?+\]?+[^\]]*+\]|.)"), F.lit(1))
    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(tokens, one_token), ""), F.lit(")\\z"))
