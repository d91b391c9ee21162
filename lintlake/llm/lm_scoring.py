"""Log-probability of texts by prediction by partial matching, and the word model it is held against.

The trie holds byte contexts of up to ``ORDER`` bytes with the counts of the bytes after them,
over all training texts (ASCII letters in lower case; 0xFF, which UTF-8 never has, stands before and
after a text).  A byte is coded at the longest context of its own that the trie has.  A context
with D different followers among T gives one of count c the part (2 c - 1) / (2 T) and escapes
with D / (2 T) to the next shorter one, where what the longer one has seen is excluded; below
order 0 all bytes not seen yet are alike.

The trie is a table of the longest contexts, each with the byte after it, and holds all of them;
counts of shorter ones are sums over those that end alike.  The ``NODES`` most frequent entries
are sent to tasks with their log-probabilities.  All other bytes of the texts, of rarer entries
and of none, are joined: contexts that end in the same two bytes meet in one task, which
has all that their bytes may escape to but the orders 0 and 1, of which there are at most 2^16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buffers as B
from .frames import written

_U = np.uint64
ORDER = 5
NODES = 1 << 20  # entries of the trie that are looked up in tasks
HEAVY = 1 << 18  # words that make up 1 / HEAVY of the training words are looked up in tasks
END = 255
MERGE = 1 << 20
PIECE_BYTES = 1 << 20  # texts worked on at once


def gram_codes(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each row, and its end, the byte and the ORDER before it as one number; and where rows start."""
    n = len(bounds) - 1
    lengths = np.diff(bounds)
    places = np.concatenate([[0], np.cumsum(lengths + ORDER + 1)])
    padded = np.full(int(places[-1]), END, np.uint8)
    inside = np.ones(len(padded), bool)
    for i in range(ORDER):
        inside[places[:-1] + i] = False
    inside[places[1:] - 1] = False
    padded[inside] = content
    wide = padded.astype(_U)
    codes = np.zeros(len(padded) - ORDER if n else 0, _U)
    for i in range(ORDER + 1 if n else 0):
        codes = (codes << _U(8)) | wide[i : len(padded) - ORDER + i]
    # Windows that begin in the last ORDER places of a row reach into the next one.
    whole = np.ones(len(codes), bool)
    for i in range(1, ORDER + 1):
        at = places[1:-1] - i
        whole[at[at < len(codes)]] = False
    return codes[whole], np.concatenate([[0], np.cumsum(lengths + 1)])


def _add(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(all_codes)
    all_codes, all_counts = all_codes[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_codes[1:] != all_codes[:-1]])) if len(all_codes) else np.zeros(0, np.int64)
    return all_codes[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def _tally(grams: bool):
    """Counts byte n-grams, or words and ends, over all texts of a task; held and sent in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out():
            merged, n = _add(codes, counts)
            return pa.RecordBatch.from_arrays([pa.array(merged.view(np.int64)), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for piece in B.pieces(batch, "text", PIECE_BYTES):
                content, bounds = B.flat(piece.column("text"))
                content = B.lower(content)
                if grams:
                    found, _ = gram_codes(content, bounds)
                else:
                    starts, ends, _ = B.words(content, bounds)
                    found = B.span_hashes(content, starts, ends)
                found = np.sort(found)
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
                codes.append(found[first])
                counts.append(np.diff(np.append(first, len(found))).astype(np.int64))
                held += len(first)
                if held > MERGE:
                    merged = _add(codes, counts)
                    codes, counts, held = [merged[0]], [merged[1]], len(merged[0])
                    if held > MERGE // 2:
                        yield out()
                        codes, counts, held = [], [], 0
        if codes:
            yield out()

    return run


class Trie:
    """Contexts of every length with total, different followers and, in the next shorter one, the total of the same followers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: sorted codes of k context bytes and the byte after them, and counts."""
        self.grams, self.counts, self.contexts, self.totals, self.kinds, self.shared = [], [], [], [], [], []
        for k, (codes, counts) in enumerate(levels):
            contexts, first = np.unique(codes >> _U(8), return_index=True)
            self.grams.append(codes)
            self.counts.append(counts.astype(float))
            self.contexts.append(contexts)
            self.totals.append(np.add.reduceat(counts, first).astype(float) if len(first) else np.zeros(0))
            self.kinds.append(np.diff(np.append(first, len(codes))).astype(float))
            if k == 0 or not len(first):
                self.shared.append(np.zeros(len(contexts)))
                continue
            below = self._find(self.grams[k - 1], codes & _U((1 << 8 * k) - 1))
            self.shared.append(np.add.reduceat(np.where(below >= 0, self.counts[k - 1][below], 0.0), first))

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Index of each key in a sorted table, or -1."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.searchsorted(table, keys).clip(max=len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of the last byte of each code after the others."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))  # not coded yet
        seen_total, seen_kinds = np.zeros(len(codes)), np.zeros(len(codes))  # of what is excluded
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(open_):
                return out
            if not len(self.contexts[k]):  # nothing was learned: nothing is coded or excluded here
                seen_total[open_], seen_kinds[open_] = 0.0, 0.0
                continue
            keys = codes[open_] & _U((1 << 8 * (k + 1)) - 1)
            context = self._find(self.contexts[k], keys >> _U(8))
            here = context >= 0
            total = np.where(here, self.totals[k][context], 0.0) - seen_total[open_]
            kinds = np.where(here, self.kinds[k][context], 0.0) - seen_kinds[open_]
            gram = self._find(self.grams[k], keys)
            coded = here & (gram >= 0)
            live = here & (kinds > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                found = np.log10((2 * self.counts[k][gram] - 1) / (2 * total))
                out[open_] += np.where(coded, found, np.where(live, np.log10(kinds / (2 * total)), 0.0))
            # One order down, exclude what this context has seen; a context that is not there excludes nothing.
            seen_total[open_] = np.where(here, self.shared[k][context], 0.0)
            seen_kinds[open_] = np.where(here, self.kinds[k][context], 0.0)
            open_ = open_[~coded]
        if len(open_):
            out[open_] -= np.log10(256.0 - seen_kinds[open_])
        return out


def fit_trie(training: DataFrame) -> DataFrame:
    """The whole trie over all texts of ``training`` (text): (code, n, total), how often a byte follows a longest context, and what follows it in all."""
    rows = training.select(F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_tally(True), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.shiftright("code", 8)))
    return written(counted.withColumn("total", total), "grams")


def _sorted(found: DataFrame, value: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Codes in their order and a value for each, brought to the driver."""
    table = found.select("code", value).toArrow()
    codes, values = table.column("code").to_numpy().astype(np.int64).view(_U), table.column(value).to_numpy().astype(kind)
    order = np.argsort(codes)
    return codes[order], values[order]


def _short(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of the orders 0 and 1: at most 2^8 and 2^16."""
    pairs = grams.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n"))
    codes, counts = _sorted(pairs, "n", np.int64)
    return [_add([codes & _U(0xFF)], [counts]), (codes, counts)]


def _frequent(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent codes and their log-probabilities, at most NODES."""
    size = F.floor(F.log2("n") * 8)
    sizes = sorted(grams.groupBy(size.alias("size")).count().collect(), reverse=True)  # at most 8 * 64 rows
    fit = np.cumsum([r["count"] for r in sizes]) <= NODES
    if not fit.any():
        return np.zeros(0, _U), np.zeros(0)
    least = sizes[int(fit.sum()) - 1]["size"]
    log = F.log10((2 * F.col("n") - 1) / (2 * F.col("total")))
    return _sorted(grams.filter(size >= least).withColumn("log", log), "log", float)


def _near(code: np.ndarray) -> np.ndarray:
    return code >> _U(8) & _U(0xFFFF)


def _walk(short, least: int):
    """Log-probabilities of the codes without a count; rows are sorted by the last two bytes of their contexts, and ``least`` of them are taken at once."""

    def logs(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        learned = counts > 0
        levels = [_add([codes[learned] & _U((1 << 8 * (k + 1)) - 1)], [counts[learned]]) for k in range(2, ORDER + 1)]
        wanted = codes[~learned]
        return pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(Trie(short.value + levels).log10(wanted))], names=["code", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held, limit = [], [], 0, least
        for batch in batches:
            codes.append(batch.column("code").to_numpy().view(_U))
            counts.append(batch.column("n").to_numpy())
            held += batch.num_rows
            if held > limit:
                both = np.concatenate(codes), np.concatenate(counts)
                near = _near(both[0])
                cut = int(np.searchsorted(near, near[-1]))  # more of the last ones may follow
                if cut:
                    yield logs(both[0][:cut], both[1][:cut])
                codes, counts, held = [both[0][cut:]], [both[1][cut:]], held - cut
                limit = held + least
        if held:
            yield logs(np.concatenate(codes), np.concatenate(counts))

    return run


def _logs(grams: DataFrame, codes: DataFrame, short) -> DataFrame:
    """(code, log) for each of ``codes`` (code), which are distinct."""
    rows = grams.select("code", "n").unionByName(codes.select("code", F.lit(0).cast("long").alias("n")))
    near = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    rows = rows.withColumn("near", near).repartition("near").sortWithinPartitions("near").select("code", "n")
    return rows.mapInArrow(_walk(short, MERGE), "code long, log double")


def _rest(row: np.ndarray, values: np.ndarray, n_rows: int) -> list[pa.Array]:
    """For each row its distinct values, and how often it has them."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    where = np.flatnonzero(new)
    sizes = pa.array(np.searchsorted(row[where], np.arange(n_rows + 1)).astype(np.int32))
    times = np.diff(np.append(where, len(values))).astype(np.int32)
    return [pa.ListArray.from_arrays(sizes, pa.array(values[where].view(np.int64))), pa.ListArray.from_arrays(sizes, pa.array(times))]


def _look_up(names: np.ndarray, logs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted names, and the logs of those; 0 for others."""
    if not len(names):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.searchsorted(names, keys).clip(max=len(names) - 1)
    known = names[at] == keys
    return known, np.where(known, logs[at], 0.0)


def _score(frequent, heavy):
    """Per text what frequent codes and words give the score and the base, and the other words and codes with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text", PIECE_BYTES):
                content, bounds = B.flat(piece.column("text"))
                content = B.lower(content)
                codes, places = gram_codes(content, bounds)
                order = np.argsort(codes)
                first = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]])) if len(codes) else np.zeros(0, np.int64)
                known, logs = _look_up(*frequent.value, codes[order][first])
                times = np.diff(np.append(first, len(codes)))
                each, open_ = np.empty(len(codes)), np.empty(len(codes), bool)
                each[order], open_[order] = np.repeat(logs, times), np.repeat(~known, times)
                scores = np.add.reduceat(each, places[:-1]) if piece.num_rows else np.zeros(0)
                open_ = np.flatnonzero(open_)
                grams = _rest(np.searchsorted(places, open_, side="right") - 1, codes[open_], piece.num_rows)

                starts, ends, first_word = B.words(content, bounds)
                hashes = B.span_hashes(content, starts, ends)
                known, logs = _look_up(*heavy.value, hashes)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                n_heavy = np.concatenate([[0], np.cumsum(known)])
                row = np.repeat(np.arange(piece.num_rows), np.diff(first_word))[~known]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(first_word) + 1),
                        pa.array(n_heavy[first_word[1:]] - n_heavy[first_word[:-1]]),
                        pa.array(total[first_word[1:]] - total[first_word[:-1]]),
                        pa.array(scores),
                        *_rest(row, hashes[~known], piece.num_rows),
                        *grams,
                    ],
                    names=["doc_id", "n_tokens", "heavy", "base", "score", "words", "times", "grams", "gram_times"],
                )

    return run


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text); ``training`` has text.

    Tokens are words, ASCII letters in lower case, and one end a text.  base_score adds up
    log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens; score is the trie's log10 probability
    of all bytes and the end.  A null text is an empty one.  Without training texts every
    byte is alike.  Rows are kept one for one.
    """
    spark = docs.sparkSession
    texts = training.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_tally(False), "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))
    counts = written(counts, "words")
    n_ends = texts.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_ends, v + (n_ends > 0)
    scale = float(n + 0.5 * (v + 1))
    log = lambda c: F.log10((c + F.lit(0.5)) / F.lit(scale))
    frequent = counts.filter(F.col("c") * HEAVY >= n).withColumn("log", log(F.col("c")))  # at most HEAVY rows
    heavy = spark.sparkContext.broadcast(_sorted(frequent, "log", float))
    trie = fit_trie(training)
    short, nodes = spark.sparkContext.broadcast(_short(trie)), spark.sparkContext.broadcast(_frequent(trie))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, heavy long, base double, score double, words array<long>, times array<int>, grams array<long>, gram_times array<int>"
    scored = written(rows.mapInArrow(_score(nodes, heavy), schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    others = lambda values, times: scored.select("row", F.inline(F.arrays_zip(F.col(values).alias("code"), F.col(times).alias("times"))))
    grams = others("grams", "gram_times")
    logs = written(_logs(trie, grams.select("code").distinct(), short), "logs")
    rest = grams.join(logs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("rare_score"))
    rare = counts.filter(F.col("c") * HEAVY < n)
    each = others("words", "times").join(rare, "code", "left")
    c = F.coalesce("c", F.lit(0))
    parts = each.groupBy("row").agg(F.sum(F.col("times") * log(c)).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("rare_known"))
    whole = scored.drop("words", "times", "grams", "gram_times").join(parts, "row", "left").join(rest, "row", "left")
    end = float(np.log10((n_ends + 0.5) / scale))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("heavy") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
