"""Repeated passages, by hashes of sliding runs of sentences.

A sentence ends after a word with a full stop, question or exclamation mark, and at a line
feed.  One of more than ``LONG`` words is also cut after each word whose hash is a multiple of
``CUT``, so that text without marks is cut at the same words wherever it stands.  Where such
words are far apart, what lies between two cuts is cut once more, before the word with the smallest hash
(of the word and its neighbours) in every ``NEAR`` words.  Cuts are then at most NEAR + 1 words
apart, and those of two copies agree from NEAR words inside, so any shared passage of over 50
words without marks holds a run, and so does any sentence of over ``LONG`` words.  Every run
of at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is hashed from the words alone;
the shortest such runs from each sentence forward and to each sentence backward cover all
longer ones, so only those are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .decontamination import small
from .frames import text_hash, written

MIN_SENTENCES = 2
MIN_WORDS = 16
LONG = 16
CUT = 6
NEAR = 8
LENGTH_BITS = 20  # sentences of one run; the others of a place number the sentences of a document
PIECE_BYTES = 1 << 20  # texts worked on at once
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_FACTORS = B.random_words(3, 13) | np.uint64(1)
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "\"')]}"]] = True


def _near_cuts(hashes: np.ndarray, begins: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Words with the smallest hash in NEAR consecutive ones strictly inside what lies between two cuts of a long sentence."""
    part = np.cumsum(begins)
    at = np.arange(1, len(hashes) - NEAR)
    at = at[long[at] & (part[at - 1] == part[at + NEAR])]
    if not len(at):
        return at
    with np.errstate(over="ignore"):
        around = np.zeros_like(hashes)
        around[1:-1] = B.splitmix(hashes[:-2] * _FACTORS[0] + hashes[1:-1] * _FACTORS[1] + hashes[2:] * _FACTORS[2])
    found, least = at.copy(), around[at]
    for i in range(1, NEAR):
        value = around[at + i]
        lower = value < least
        found[lower], least[lower] = at[lower] + i, value[lower]
    return np.unique(found)


def sentences(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and hashes, each row's first word, sentences' first words, and each row's first sentence."""
    starts, ends, first = B.words(content, bounds)
    hashes = B.span_hashes(content, starts, ends)
    n = len(starts)
    if not n:
        return starts, hashes, first, np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    last = content[ends - 1]
    before = content[np.maximum(ends - 2, 0)]
    stop = _ENDS[last] | (_CLOSING[last] & _ENDS[before] & (ends - starts > 1))
    feeds = np.concatenate([[0], np.cumsum(content == 10)])
    stop[:-1] |= feeds[starts[1:]] > feeds[ends[:-1]]
    row_start = np.zeros(n + 1, bool)
    row_start[first] = True
    begins = row_start[:n].copy()
    begins[1:] |= stop[:-1]
    at = np.flatnonzero(begins)
    long = np.repeat(np.diff(np.append(at, n)) > LONG, np.diff(np.append(at, n)))
    cut = long & (hashes % np.uint64(CUT) == 0)
    begins[1:] |= cut[:-1]
    begins[_near_cuts(hashes, begins, long)] = True
    at = np.flatnonzero(begins)
    return starts, hashes, first, at, np.searchsorted(at, first)


def _runs(at: np.ndarray, n_words: int, first: np.ndarray, min_words: int, min_sentences: int, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in sentences) of the shortest run with enough words and sentences from, or to, each sentence; none crosses a row."""
    total = np.append(at, n_words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    i = np.arange(len(at))
    if forward:
        ends = np.maximum(np.searchsorted(total, total[:-1] + min_words, side="left"), i + min_sentences)
        whole = ends <= first[row + 1]
        return i[whole], ends[whole]
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, i + 1 - min_sentences)
    whole = starts >= first[row]
    return starts[whole], i[whole] + 1


def _hash(min_words: int, min_sentences: int):
    """One row a run: its hash, and its document, first sentence and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text", PIECE_BYTES):
                content, bounds = B.flat(piece.column("text"))
                starts, hashes, first_word, at, first = sentences(content, bounds)
                both = [_runs(at, len(starts), first, min_words, min_sentences, forward) for forward in (True, False)]
                # Most runs are the shortest ones both ways: those are sent once.
                begin, end = (np.concatenate(x) for x in zip(*both, strict=True))
                spot = np.unique(begin * (len(at) + 1) + end)
                begin, end = spot // (len(at) + 1), spot % (len(at) + 1)
                upto = np.append(at, len(starts))
                spans = B.sequence_hashes(hashes, upto[begin], upto[end]).view(np.int64)
                row = np.searchsorted(first, begin, side="right") - 1
                place = ((begin - first[row]) << LENGTH_BITS) | (end - begin)
                ids, texts = (piece.column(c).take(pa.array(row)) for c in ("_id", "_t"))
                yield pa.RecordBatch.from_arrays([pa.array(spans), ids, texts, pa.array(place)], names=["span", "_id", "_t", "place"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with _t, the text hash of documents that share their _id with another text, and 0 for all others.

    Ids are unique as a rule, and then a place needs no hash beside the id.
    """
    shared = docs.groupBy("_id").agg(F.min("_h").alias("least"), F.max("_h").alias("most")).filter("least <> most")
    shared = written(shared.select("_id", F.lit(True).alias("shared")), "shared-ids")
    marked = docs.join(small(shared, F.lit(16)), "_id", "left")
    return marked.withColumn("_t", F.when(F.col("shared"), F.col("_h")).otherwise(F.lit(0))).drop("shared")


def repeated_sentences(docs: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(_id, _t, repeated, gone): sentence indexes inside any repeated run, and inside one that begins earlier as well.

    ``docs`` has _id, _t and text; equal (_id, _t) count once.  Only documents with a repeated run have a row.

    Runs are shuffled once, by their hash, and sorted there; all occurrences of a run stand together,
    of which only the first and the last place are kept in mind, so a very common passage takes no more memory than a rare one.
    """
    runs = docs.filter("text IS NOT NULL").select("_id", "_t", "text").mapInArrow(_hash(min_words, min_sentences), "span long, _id long, _t long, place long")
    own, alike = F.struct("_id", "_t", "place"), Window.partitionBy("span")
    # Equal rows of documents have equal places: those are one occurrence.
    placed = runs.withColumns({"first": F.min(own).over(alike), "last": F.max(own).over(alike)}).filter("first < last")
    spot = F.shiftleft("place", 1).bitwiseOR((own > F.col("first")).cast("long"))
    found = placed.groupBy("_id", "_t").agg(F.collect_set(spot).alias("spots"))
    found = written(found, "repeats")

    def inside(spots: str | Column) -> Column:
        at = lambda p: F.shiftright(p, LENGTH_BITS + 1).cast("int")
        length = lambda p: F.shiftright(p, 1).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")
        return F.array_sort(F.array_distinct(F.flatten(F.transform(spots, lambda p: F.sequence(at(p), at(p) + length(p) - 1)))))

    later = F.filter("spots", lambda p: p.bitwiseAND(F.lit(1)) == 1)
    return found.select("_id", "_t", inside("spots").alias("repeated"), inside(later).alias("gone"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in B.pieces(batch, "text"):
            text = piece.column("text")
            content, bounds = B.flat(text)
            starts, _, _, at, first = sentences(content, bounds)
            out, counts = [], np.diff(first)
            for i, gone in enumerate(piece.column("gone").to_pylist()):
                if not gone:
                    out.append(text[i].as_py())
                    continue
                # A sentence reaches from its first word to the next one's; what stands before the first stays.
                edges = np.append(starts[at[first[i] : first[i + 1]]], bounds[i + 1])
                keep = np.ones(len(edges) - 1, bool)
                keep[gone] = False
                parts = [content[bounds[i] : edges[0]], *(content[edges[k] : edges[k + 1]] for k in np.flatnonzero(keep))]
                out.append(b"".join(p.tobytes() for p in parts).decode())
            names = piece.schema.names
            columns = [piece.column(c) if c != "text" else pa.array(out, pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=[*names, "n_sentences"])


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """(doc_id, text, n_sentences, n_repeated, n_removed) per row of ``docs`` (doc_id, text).

    n_repeated: sentences inside a run that stands in more than one place; n_removed: those
    inside a run that begins earlier as well, in a document with a smaller doc_id (null
    first, equal ids by a hash of the text) or further up; text is without them.  Null stays
    null; blank texts have no sentence.  Rows equal in doc_id and text count as one document.
    """
    keyed = docs.select("doc_id", "text").withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": text_hash()})
    keyed = _numbered(keyed)
    marked = repeated_sentences(keyed, min_words, min_sentences)
    # The marks grow with the documents, so they meet them in a shuffle at every size.
    joined = keyed.join(marked.hint("merge"), ["_id", "_t"], "left").select("doc_id", "text", "repeated", "gone")
    done = joined.mapInArrow(_cut, "doc_id long, text string, repeated array<int>, gone array<int>, n_sentences long")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return done.select("doc_id", "text", "n_sentences", count("repeated").alias("n_repeated"), count("gone").alias("n_removed"))
