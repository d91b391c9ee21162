"""Search in lines through an index of trigrams.

The index of a corpus is three tables: its ``lines``, numbered, in blocks of files, the ``postings`` (trigram, n, base,
places) of stretches of lines, and the ``lengths`` of the posting lists.  A pattern is reduced to texts that every
match contains; their trigrams are intersected from the rarest list on, and only the lines
that are left are read and tried.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as codes
from re import _parser as patterns

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.functions.findings import explode_items

BLOCKS = 256
_LINES = "path string, line_num int, line string, id bigint, block int"
# The lines ``base`` + place, for each of ``n`` places, hold the trigram.
_POSTINGS = "trigram string, n int, base bigint, places array<int>"
_PLACE_BITS = 31
STRETCH = 1 << 21  # characters whose postings are sorted at once
# Lists that are intersected; the lines left are tried against the pattern anyway.
MOST_LISTS = 4


@dataclass(frozen=True)
class LineIndex:
    lines: DataFrame
    postings: DataFrame
    lengths: DataFrame


def required_texts(regex: str) -> list[str]:
    """Texts of which every match contains all; none if nothing is certain.

    Follows the syntax tree of the pattern: literals in a row make a text; anything that can vary
    ends it.  What is optional or one of several branches requires nothing.
    """
    tree = patterns.parse(regex)
    if tree.state.flags & (int(codes.SRE_FLAG_IGNORECASE) | int(codes.SRE_FLAG_VERBOSE)):
        return []
    found: list[str] = []

    def follow(items, run: str) -> str:
        for code, value in items:
            if code is codes.LITERAL:
                run += chr(value)
            elif code is codes.SUBPATTERN and not value[1] and not value[2]:
                run = follow(value[3], run)
            elif code is codes.AT:
                continue  # takes no room
            else:
                found.append(run)
                run = ""
                if code in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
                    # At least once: what it holds is required, but nothing is known about its neighbours.
                    found.append(follow(value[2], ""))
                elif code is codes.ATOMIC_GROUP:
                    found.append(follow(value, ""))
        return run

    found.append(follow(tree, ""))
    return [text for text in dict.fromkeys(found) if text]


def required_trigrams(regex: str) -> list[str]:
    texts = required_texts(regex)
    return sorted({text[i : i + 3] for text in texts for i in range(len(text) - 2)})


def _stretch(base: int, ids: list[np.ndarray], lines: list[bytes]) -> pa.RecordBatch:
    """The postings of some lines, one row per trigram of three characters, in the order of their codes."""
    text = b"\n".join(lines).decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = codes == 10  # no line holds one
    row = np.cumsum(ends)
    inside = np.flatnonzero(~(ends[:-2] | ends[1:-1] | ends[2:])) if len(codes) > 2 else np.zeros(0, np.int64)
    grams = codes[inside] << 42 | codes[inside + 1] << 21 | codes[inside + 2]
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[inside][order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    offsets = np.append(first, len(grams)).astype(np.int32)
    names = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams[first].tolist()]
    places = (np.concatenate(ids) - base)[row].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(np.diff(offsets)), pa.array(np.full(len(first), base)), pa.ListArray.from_arrays(offsets, places)],
        names=["trigram", "n", "base", "places"],
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (id, line), a bounded stretch of lines at a time; a stretch has one base."""
    base, ids, lines, size = 0, [], [], 0
    for batch in batches:
        numbers = batch.column("id").to_numpy()
        texts = batch.column("line").cast(pa.binary()).to_pylist()
        cuts = np.flatnonzero(np.diff(numbers >> _PLACE_BITS)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            while start < end:
                here = int(numbers[start]) >> _PLACE_BITS << _PLACE_BITS
                if lines and (size >= STRETCH or here != base):
                    yield _stretch(base, ids, lines)
                    ids, lines, size = [], [], 0
                base, stop = here, start
                while stop < end and size < STRETCH:
                    size += len(texts[stop]) + 1
                    stop += 1
                ids.append(numbers[start:stop])
                lines += texts[start:stop]
                start = stop
    if lines:
        yield _stretch(base, ids, lines)


def write_line_index(files: DataFrame, location: str, blocks: int = BLOCKS) -> LineIndex:
    """Indexes the lines (split on LF only) of (path, text).

    Every task lists the trigrams of its own lines, a stretch at a time, and writes them in their order, so no
    posting is shuffled, a trigram has a few rows a file and a filter on it reads only the pages that hold it.
    """
    spark = files.sparkSession
    numbered = explode_items(files, ["path"], F.split("text", "\n", -1), "pos", "line")
    block = F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int")
    rows = numbered.select("path", (F.col("pos") + 1).alias("line_num"), "line", block.alias("block"))
    laid = rows.hint("rebalance", F.col("block")).withColumn("id", F.monotonically_increasing_id())
    laid.write.partitionBy("block").parquet(f"{location}/lines")
    lines = spark.read.schema(_LINES).parquet(f"{location}/lines")
    grams = lines.select("id", "line").mapInArrow(_postings, _POSTINGS)
    grams.sortWithinPartitions("trigram", "base").write.parquet(f"{location}/postings")
    postings = spark.read.schema(_POSTINGS).parquet(f"{location}/postings")
    counted = postings.groupBy("trigram").agg(F.sum("n").alias("n"))
    counted.sort("trigram").write.parquet(f"{location}/lengths")
    return open_line_index(spark, location)


def open_line_index(spark: SparkSession, location: str) -> LineIndex:
    return LineIndex(
        spark.read.schema(_LINES).parquet(f"{location}/lines"),
        spark.read.schema(_POSTINGS).parquet(f"{location}/postings"),
        spark.read.schema("trigram string, n bigint").parquet(f"{location}/lengths"),
    )


def candidate_lines(index: LineIndex, regex: str) -> DataFrame:
    """The lines that hold the rarest of the trigrams that every match contains; all lines if there are none."""
    wanted = required_trigrams(regex)
    if not wanted:
        return index.lines
    known = index.lengths.filter(F.col("trigram").isin(wanted)).collect()  # as many rows as the pattern has trigrams
    if len(known) < len(wanted):
        return index.lines.limit(0)  # some trigram is nowhere
    rarest = [row.trigram for row in sorted(known, key=lambda row: (row.n, row.trigram))[:MOST_LISTS]]
    def places(trigram: str) -> DataFrame:
        held = index.postings.filter(F.col("trigram") == trigram).select("base", F.explode("places").alias("place"))
        return held.select((F.col("base") + F.col("place")).alias("id"))

    left = places(rarest[0])
    for trigram in rarest[1:]:
        left = left.join(places(trigram), "id", "left_semi")
    return index.lines.join(left, "id", "left_semi")


def grep_indexed(index: LineIndex, regex: str) -> DataFrame:
    """(path, line_num, line) of matching lines, trimmed: the answer of ``grep`` from the index."""
    hits = candidate_lines(index, regex).filter(F.col("line").rlike(X.py_regex(regex)))
    return hits.select("path", "line_num", X.py_strip(F.col("line")).alias("line"))


def grep_report(index: LineIndex, regex: str) -> DataFrame:
    """(n_lines, n_read, n_found): the lines of the corpus, those that were tried and those that match."""
    matches = F.col("line").rlike(X.py_regex(regex))
    tried = candidate_lines(index, regex).select(F.lit(0).alias("a"), F.lit(1).alias("b"), matches.cast("int").alias("c"))
    counted = index.lines.select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).unionByName(tried)
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("a", "n_lines"), ("b", "n_read"), ("c", "n_found"))])


# The function that runs in tasks is shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
