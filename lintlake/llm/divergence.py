"""How the sources of a language differ in their words.

Every document becomes an exact sparse vector of term counts.  As a count vectorizer with a
minimum document frequency and no limit of its size would, each language keeps the terms that enough
of its documents hold.  The vectorizer of Spark's ML library brings the vocabulary to the driver, one language at
a time, and so fails on large ones; here vocabulary and vectors are tables for all languages at once.

Document vectors are summed up per (language, source), and pairs of sources are evaluated
on these sparse sums.  With smoothed shares p and q (whole billionths) two sources differ in a term by
f = (p - q)^2 div (p + q).  A term that both lack adds f0, the same for all such terms; so over V terms

    sum f = V * f0 + sum over g's terms of (f(p, q0) - f0) + sum over o's terms of (f(p0, q) - f0)
            + sum over common terms of (f(p, q) - f(p, q0) - f(p0, q) + f0)

The two middle sums need only how many terms have each share; only common terms are taken
pairwise, within the (bounded) list of a term's sources, and summed up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .frames import written

SCALE = 1_000_000_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def document_vectors(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, term, count) of every term in every row of a batch with a text, and the terms themselves."""
    content, bounds = B.flat(piece.column("text"))
    keep = _LETTER[content]
    starts, ends = B.spans(keep, bounds)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = B.lower(content[keep]).tobytes()
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters))
    coded = words.dictionary_encode()
    rows = np.repeat(np.arange(piece.num_rows), np.diff(np.searchsorted(starts, bounds)))
    terms = max(len(coded.dictionary), 1)
    cells, counts = np.unique(rows * terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return cells // terms, cells % terms, counts, coded.dictionary


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each group within a piece of a batch: in how many rows a term is, and how often."""
    for batch in batches:
        for piece in B.pieces(batch, "text"):
            rows, terms, counts, names = document_vectors(piece)
            (lang, langs), (source, sources) = _codes(piece.column("lang")), _codes(piece.column("source"))
            cells = ((lang * len(sources) + source)[rows]) * max(len(names), 1) + terms
            order = np.argsort(cells, kind="stable")
            cells, first, n_docs = np.unique(cells[order], return_index=True, return_counts=True)
            n = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
            group, term = cells // max(len(names), 1), cells % max(len(names), 1)
            columns = [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources)))]
            yield pa.RecordBatch.from_arrays(
                [*columns, names.take(pa.array(term)).cast(pa.string()), pa.array(n_docs, pa.int64()), pa.array(n, pa.int64())],
                names=["lang", "source", "term", "n_docs", "n"],
            )


def _share(count: str | int, total: str, terms: str) -> Column:
    """1 + SCALE * (count + 2) div (total + 2 * terms), exact beyond the range of a long."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language lie apart, and in what.

    ``docs`` has text, lang, source, null read as ''.  Terms are runs of ASCII letters and of all characters beyond ASCII,
    A-Z in lower case.  Part ``pair``: every other source of the language with the sum of f over all kept terms
    (0 where none is kept).  Part ``term``: the ``top`` terms of the group whose share is above the language's,
    by f.  Ranks start at 1 in each group and part, by value descending, then item by its bytes.  Every row is a document, repeated
    ones too; groups without terms take part with counts of 0; an empty table gives no rows.  Other columns are ignored.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    summed = docs.mapInArrow(_sum_vectors, "lang string, source string, term string, n_docs long, n long")
    summed = written(summed.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "group-sums")

    # A term's sources within a language: at most as many rows as there are sources.
    of_term = summed.groupBy("lang", "term").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    kept = written(of_term.filter(F.col("n_docs") >= min_docs).drop("n_docs"), "kept-terms")

    terms = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "total_lang"])
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _share(0, "total", "v")).otherwise(F.lit(1))), "groups")

    shares = kept.select("lang", "term", "n_lang", F.explode("sources").alias("s")).select("lang", "term", "n_lang", "s.*")
    shares = shares.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "v"), "q": _share("n_lang", "total_lang", "v")})
    shares = written(shares.select("lang", "source", "term", "p", "q", "p0"), "shares")

    words = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "v", "p0").join(other, "lang").filter("source <> item")
    base = pairs.select("lang", "source", "item", F.expr(f"v * {_f('p0', 'q0')}").alias("value"))
    alike = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m")).join(other, "lang").filter("source <> item")
    own = alike.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"m * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("value"))
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("l"))
    common = lists.select("lang", F.explode("l").alias("x"), "l").select("lang", "x", F.explode(F.filter("l", lambda y: y["source"] > F.col("x.source"))).alias("y"))
    more = " + ".join([_f("x.p", "y.p"), _f("x.p0", "y.p0")]) + " - " + " - ".join([_f("x.p", "y.p0"), _f("x.p0", "y.p")])
    both = common.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(F.expr(more)).alias("value"))
    turned = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    own, both = written(own, "own-terms"), written(both, "common-terms")
    parts = base
    for each in (own, turned(own), both, turned(both)):
        parts = parts.unionByName(each)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def ranked(part: str, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked("pair", pairs).unionByName(ranked("term", words).filter(F.col("rank") <= top))
