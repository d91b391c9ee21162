"""Periodic runs of words by dyadic catching of squares.

A run is a longest stretch of words with smallest period q that holds it often enough.  Words
are appended in blocks whose sizes are powers of two.  Over every completed block of 2^k words stand
catchers, one for each period p from 2^(k+1) to 2^(k+2) - 1: the first half of a square of that period,
wherever it lies, holds a whole block, whose copy stands p words on.  (Periods up to 3 are caught
word by word.)  A catcher that holds compares the suffixes of what came before with what comes
after; squares of one period that follow each other merge, so a run is the stretch of caught
blocks and less than one block on either side.

The catchers of one level advance together over all documents of a piece of text: 2 comparisons a
word and level.  A document takes part in a level only while it is long enough for a run of
its periods.  A stretch inside a run whose period divides p is that run again and is not followed.
Words are compared by 64-bit hashes within a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B

_U = np.uint64
_CELLS = 1 << 21  # comparisons held at once
_ODD = _U(0xD1342543DE82EF95)

RUNS = "array<struct<start:long,length:long,period:long>>"


class _Known:
    """Runs found so far, sorted by start, to tell stretches that are one of them again."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start, end, period):
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        self.start, self.end, self.period = start[order], end[order], period[order]
        # Among those that start no later, the one that ends last: if any holds a stretch, this one does,
        # and two runs do not share as much as the sum of their periods.
        self.reach = np.maximum.accumulate(self.end)
        self.holder = np.maximum.accumulate(np.where(self.end == self.reach, np.arange(len(order)), 0))

    def hold(self, start, end, period) -> np.ndarray:
        if not len(self.start):
            return np.zeros(len(start), bool)
        at = np.searchsorted(self.start, start, side="right") - 1
        some = np.maximum(at, 0)
        return (at >= 0) & (self.reach[some] >= end) & (period % self.period[self.holder[some]] == 0)


def _stretches(caught: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and one past the last column of each stretch of true cells."""
    wide = np.zeros((len(caught), caught.shape[1] + 2), np.int8)
    wide[:, 1:-1] = caught
    change = np.diff(wide, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1]


def _more(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of 1 or -1, equal the word one period later; at most ``most``."""
    out = np.zeros(len(at), np.int64)
    reach = np.arange(most) * step
    for i in range(0, len(at), max(_CELLS // most, 1)):
        rows = slice(i, i + max(_CELLS // most, 1))
        place = at[rows, None] + reach
        equal = (place >= 0) & (place + period[rows, None] < len(words))
        place = np.where(equal, place, 0)
        equal &= words[place] == words[np.where(equal, place + period[rows, None], 0)]
        out[rows] = np.where(equal.all(axis=1), most, equal.argmin(axis=1))
    return out


def find_runs(words: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of every run, by row, start and period.

    ``words`` holds the word hashes of all rows, ``first`` where each row starts and, last, their number.
    """
    sizes = np.diff(first)
    rows = np.arange(len(sizes))
    known = _Known()
    level = 0
    with np.errstate(over="ignore"):
        # A word of its own after each row, so that nothing is equal across rows.
        ends = B.splitmix(B.random_words(max(len(rows), 1), 17)[: len(rows)])
        flat = np.insert(words, first[1:], ends)
        shift = first[:-1] + rows  # where each row starts in flat
        start, hashes = shift.copy(), flat
        block = flat
        while True:
            low = 1 if level == 0 else 1 << (level + 1)
            high, step = 1 << (level + 2), 1 << level
            stays = sizes[rows] >= max(min_length, min_exponent * low)
            if not stays.any():
                break
            if not stays.all():
                keep = np.repeat(stays, sizes[rows] + 1)
                hashes, block, rows = hashes[keep], block[keep], rows[stays]
                start = np.concatenate([[0], np.cumsum(sizes[rows] + 1)[:-1]])
            if level:  # blocks of this level from two of the one below
                half = step >> 1
                later = np.zeros_like(block)
                later[: max(len(block) - half, 0)] = block[half:]
                block = B.splitmix(block * _ODD + later)
            own = block[::step]
            each = max(_CELLS // max(len(own), 1), 1)
            longest = int(sizes[rows].max())
            for p0 in range(low, min(high, longest // min_exponent + 1), each):
                periods = np.arange(p0, min(p0 + each, high, longest // min_exponent + 1))
                place = periods[:, None] + np.arange(0, len(block), step)
                caught = block[np.minimum(place, len(block) - 1)] == own
                caught &= place < len(block)
                row, a, b = _stretches(caught)
                period = periods[row]
                need = np.maximum(min_length - period, (min_exponent - 1) * period)
                a, b = a * step, b * step  # words that equal the one a period later: at least from a to b
                some = b - a >= need - 2 * (step - 1)
                a, b, period, need = a[some], b[some], period[some], need[some]
                of = np.searchsorted(start, a, side="right") - 1
                offset = shift[rows[of]] - start[of]
                some = ~known.hold(a + offset, b + period + offset, period)
                a, b, period, need, offset = a[some], b[some], period[some], need[some], offset[some]
                if not len(a):
                    continue
                if step > 1:
                    a = a - _more(hashes, a - 1, period, -1, step - 1)
                    b = b + _more(hashes, b, period, 1, step - 1)
                some = b - a >= need
                a, b, period = (a + offset)[some], (b + period + offset)[some], period[some]
                # Within a level a stretch may be caught with several multiples of its period (level 0 only).
                order = np.lexsort((period, b, a))
                a, b, period = a[order], b[order], period[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                new &= ~known.hold(a, b, period)
                if new.any():
                    known.add(a[new], b[new], period[new])
            level += 1
    row = np.searchsorted(shift, known.start, side="right") - 1
    order = np.lexsort((known.period, known.start))
    return row[order], (known.start - shift[row])[order], (known.end - known.start)[order], known.period[order]


def _dropped(row, start, length, period, first: np.ndarray) -> np.ndarray:
    """For every word, whether a run holds it after that run's first period."""
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, first[row] + start + period, 1)
    np.add.at(change, first[row] + start + length, -1)
    return np.cumsum(change)[:-1] > 0


def _joined(content, starts, ends, first) -> pa.Array:
    """The words of each row, joined by single blanks."""
    lengths = ends - starts + 1  # each with a blank behind it
    upto = np.concatenate([[0], np.cumsum(lengths)])
    source = np.arange(upto[-1]) + np.repeat(starts - upto[:-1], lengths)
    out = content[np.minimum(source, max(len(content) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out[upto[1:] - 1] = 0x20
    some = first[1:] > first[:-1]
    keep = np.ones(len(out), bool)
    keep[upto[first[1:][some]] - 1] = False  # no blank after a row's last word
    sizes = upto[first[1:]] - upto[first[:-1]] - some
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of consecutive words with smallest
    period q and length >= max(min_length, min_exponent * q) that no neighbouring word extends keeping the period;
    ``runs`` is sorted by start, then period.  min_exponent is a whole number of at least 2.  ``collapsed`` holds
    the words that no run contains after its first q words, joined by single blanks.  Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``.  Each row is worked on alone, so nulls in doc_id
    and repeated rows are kept as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text", 1 << 20):
                content, bounds = B.flat(piece.column("text"))
                starts, ends, first = B.words(content, bounds)
                row, start, length, period = find_runs(B.span_hashes(content, starts, ends), first, min_length, min_exponent)
                keep = ~_dropped(row, start, length, period, first)
                left = np.concatenate([[0], np.cumsum(keep)])[first]
                parts = [pa.array(x, pa.int64()) for x in (start, length, period)]
                offsets = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                columns = [piece.column("doc_id"), pa.array(np.diff(first), pa.int64()), runs, _joined(content, starts[keep], ends[keep], left)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with periodic endings: a fixture rule, for documents whose crc32(doc_id) ends in 0.

    With h = crc32(doc_id), g = h div 10 and n > 0 words, each word i >= a becomes the word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8).  Only changed texts are rewritten, words joined by blanks.  A null doc_id changes nothing.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", number.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    )
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    placed = split.withColumns({"n": n, "a": F.when(n > 0, g % n)}).withColumn("p", 1 + F.expr("(n - a) div (3 + (h div 10) % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs of each row in brief: their number, the one of greatest exponent, and hashes of all runs and of what is left."""
    # Greatest length / period, compared as whole numbers; runs come by start, then period, so the first of equals stays.
    greater = "x.length * acc.period > acc.length * x.period"
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (acc, x) -> IF({greater}, x, acc))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
