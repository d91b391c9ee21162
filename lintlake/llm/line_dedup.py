"""Repeated runs of lines, by a suffix array over line IDs.

All documents form one sequence of lines, in the order of (doc_id, text hash), with a gap
after each document.  Prefix doubling sorts its suffixes: the rank of a line comes first, then
ranks of 2, 4, 8 ... lines, each from two of the length before.  A rank is the place in the
suffix array where its group begins; suffixes with one rank after k rounds share 2**k
lines, that is they form an interval of the array whose longest common prefix is at least
2**k.  A suffix that is alone in its group leaves the rounds.

A run counts if it holds ``min_words`` words.  A line goes if it lies in such a run that
begins earlier as well.  The shortest such runs from each line forward and to each line
backward cover every longer one, so the rounds end with the longest of those, and every
maximal repeated run is still found whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .frames import running, text_hash, written

MIN_WORDS = 6
_NEWLINE = 10


def lines(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the index of each row's first; every row has a line."""
    breaks = np.flatnonzero(content == _NEWLINE)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    per_row = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])
    # A break that ends a row is followed by that row's last, empty line; order by row to keep it there.
    row = np.repeat(np.arange(len(bounds) - 1), per_row)
    inner = np.ones(len(row), bool)
    inner[first[:-1]] = False
    starts = np.empty(len(row), np.int64)
    starts[first[:-1]] = bounds[:-1]
    starts[inner] = breaks + 1
    ends = np.empty(len(row), np.int64)
    last = np.zeros(len(row), bool)
    last[first[1:] - 1] = True
    ends[last] = bounds[1:]
    ends[~last] = breaks
    return starts, ends, first


def _hash(content: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    some = ends > starts
    out[some] = B.span_hashes(content, starts[some], ends[some], seed)
    return out.view(np.int64)


def _runs(n_words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the shortest runs with enough words, from each line and to each line of one row."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    n = len(n_words)
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    forward, backward = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    pairs = np.unique(
        np.concatenate(
            [np.stack([forward, ends[forward] - forward], 1), np.stack([starts[backward], backward + 1 - starts[backward]], 1)]
        ),
        axis=0,
    )
    return pairs[:, 0], pairs[:, 1]


def _number(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                content, bounds = B.flat(piece.column("text"))
                starts, ends, first = lines(content, bounds)
                word_starts, _, _ = B.words(content, bounds)
                n_words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                one, two = _hash(content, starts, ends, 0), _hash(content, starts, ends, 1)
                found = [_runs(n_words[a:b], min_words) for a, b in zip(first[:-1], first[1:], strict=True)]
                sizes = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])])
                flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1)]
                as_list = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("_id"),
                        piece.column("_h"),
                        pa.array(np.diff(first)),
                        as_list(first, one, pa.int64()),
                        as_list(first, two, pa.int64()),
                        as_list(sizes, flat[0].astype(np.int32), pa.int32()),
                        as_list(sizes, flat[1].astype(np.int32), pa.int32()),
                    ],
                    names=["_id", "_h", "n_lines", "one", "two", "run_at", "run_length"],
                )

    return run


def _doubled(ranks: DataFrame, width: int) -> DataFrame:
    """Ranks of 2 * width lines from ranks of width lines; only positions that share their rank."""
    after = ranks.select((F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
    both = written(ranks.join(after, "pos").filter(F.col("pos") + 2 * width <= F.col("end")), "doubled")
    groups = both.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1")
    placed = running(groups, ["rank", "next"], "n", "place", "places")
    return written(both.join(placed, ["rank", "next"]).select("pos", "end", F.col("place").alias("rank")), "ranks")


def _repeated(runs: DataFrame, ranks: DataFrame, width: int) -> DataFrame:
    """Runs (width to 2 * width - 1 lines) that begin earlier as well."""
    head = runs.join(ranks.select("pos", F.col("rank").alias("r1")), "pos")
    if width > 1:
        tail = ranks.select(F.col("pos").alias("tail"), F.col("rank").alias("r2"))
        head = head.withColumn("tail", F.col("pos") + F.col("length") - width).join(tail, "tail")
    else:
        head = head.withColumn("r2", F.lit(0))
    first = head.groupBy("length", "r1", "r2").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return head.join(first, ["length", "r1", "r2"]).filter("pos > first").select("_id", "_h", "at", "length")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _h, n_lines, gone): per document the indexes of the lines that an earlier run covers.

    ``docs`` has _id, _h and text; equal (_id, _h) count once.
    """
    schema = "_id long, _h long, n_lines long, one array<long>, two array<long>, run_at array<int>, run_length array<int>"
    numbered = docs.filter("text IS NOT NULL").select("_id", "_h", "text").mapInArrow(_number(min_words), schema)
    values = ["n_lines", "one", "two", "run_at", "run_length"]
    own = written(numbered.groupBy("_id", "_h").agg(*[F.first(c).alias(c) for c in values]), "lines")
    starts = running(own.select("_id", "_h", (F.col("n_lines") + 1).alias("room")), ["_id", "_h"], "room", "base", "bases")
    based = written(own.join(starts.select("_id", "_h", "base"), ["_id", "_h"]), "based")
    end = F.col("base") + F.col("n_lines")
    all_lines = based.select("base", end.alias("end"), F.posexplode(F.arrays_zip("one", "two")).alias("i", "line"))
    all_lines = all_lines.select((F.col("base") + F.col("i")).alias("pos"), "end", "line.one", "line.two")
    runs = based.select("_id", "_h", "base", F.explode(F.arrays_zip("run_at", "run_length")).alias("r")).select(
        "_id", "_h", F.col("r.run_at").alias("at"), (F.col("base") + F.col("r.run_at")).alias("pos"), F.col("r.run_length").alias("length")
    )
    same = all_lines.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
    placed = running(same, ["one", "two"], "n", "rank", "line-ranks").drop("n")
    ranks = written(all_lines.join(placed, ["one", "two"]).select("pos", "end", "rank"), "ranks")
    longest = runs.agg(F.max("length")).first()[0] or 0
    width, found = 1, None
    while width <= longest:
        # Written at once: the driver plans one width at a time, however many there are.
        here = written(_repeated(runs.filter((F.col("length") >= width) & (F.col("length") < 2 * width)), ranks, width), "repeated")
        found = here if found is None else found.unionByName(here)
        if ranks.isEmpty():
            break
        width *= 2
        if width <= longest:
            ranks = _doubled(ranks, width // 2)
    if found is None:
        return based.select("_id", "_h", "n_lines", F.array().cast("array<int>").alias("gone"))
    covered = found.groupBy("_id", "_h").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("length") - 1))))).alias("gone")
    )
    return own.select("_id", "_h", "n_lines").join(covered, ["_id", "_h"], "left").withColumn(
        "gone", F.coalesce("gone", F.array().cast("array<int>"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_lines, n_removed and the text without repeated runs.

    Lines end at a line feed.  A line goes if it is covered by a run of consecutive lines of
    its document, together at least ``min_words`` words, that also begins at an earlier
    position: in a document with a smaller doc_id (null first, equal ids by a hash of the text)
    or further up.  Kept lines are joined by line feeds again.  A null text stays null with 0
    lines; an empty one has one empty line.  Rows equal in doc_id and text count as one
    document and get the same result.  Columns of those names in ``docs`` are replaced.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), text_hash().alias("_h"), "text")
    decided = repeated_runs(keyed, min_words)
    decided = decided.select("_id", "_h", F.struct("n_lines", "gone").alias("cut"))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("cut.gone", i))
    text = F.when(F.size("cut.gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    joined = keyed.join(decided, ["_id", "_h"], "left").select(
        "row", text.alias("text"), F.coalesce("cut.n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("cut.gone"), F.lit(0)).cast("long").alias("n_removed")
    )
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(*[F.col("row")[c].alias(c) for c in others], "text", "n_lines", "n_removed")
