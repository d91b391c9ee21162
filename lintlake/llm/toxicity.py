"""Toxic passages: maximal scoring segments over word log-odds.

A word's features are itself and its first 4, 5 and 6 bytes.  A feature's score is its
log-odds between toxic and other texts, by the number of different texts that have it, under
an informative Dirichlet prior (the counts of both together), moved towards 0 by two standard
errors; only features beyond what the largest of so many chance features reaches have one.
Of a word's features the most significant one
counts, and every word costs ``DRIFT``.  A linear scan finds all maximal
scoring segments of a text.  Scores of the best r segments of a text follow an extreme-value law with
parameters lambda (from the word scores of other texts) and K; the most surprising r gives
the text's statistic, and a monotone fit on labelled texts turns that into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .decontamination import small
from .frames import written

_U = np.uint64
PREFIXES = (4, 5, 6)
PRIOR = 0.25  # weight of the prior, as a part of all training words
MAX_FEATURES = 1 << 18  # the most significant ones; bounds the model that is sent out
DRIFT = 0.05
SIGNIFICANT = 0.01  # expected number of chance segments at which a passage is reported
_STEP, _LOW, _HIGH = 0.5, -60.0, 240.0  # bins of the statistic
_BIN = 0.25  # bins of word scores
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_features(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each word (one row a word), each row's first word, and words' starts and ends."""
    starts, ends = B.spans(_WORD[content], bounds)
    columns = [B.span_hashes(content, starts, ends)]
    for k in PREFIXES:
        columns.append(B.span_hashes(content, starts, np.minimum(ends, starts + k), seed=k))
    return np.stack(columns, 1), np.searchsorted(starts, bounds), starts, ends


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, by label, the texts that have a feature; one text's repetitions say nothing new."""
    for batch in batches:
        for piece in B.pieces(batch, "text"):
            content, bounds = B.flat(piece.column("text"))
            features, first, _, _ = word_features(B.lower(content), bounds)
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.repeat(np.arange(piece.num_rows), np.diff(first)), features.shape[1])
            with np.errstate(over="ignore"):
                _, once = np.unique(features.ravel() + row.astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True)
            known, which = np.unique(features.ravel()[once], return_inverse=True)
            both = np.bincount(which, minlength=len(known))
            ones = np.bincount(which, weights=toxic[row[once]], minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(known.view(np.int64)), pa.array(ones), pa.array(both - ones)], names=["feature", "y1", "y0"]
            )


class Model:
    """Feature scores, sorted by feature, and the calibration."""

    def __init__(self, features: np.ndarray, scores: np.ndarray, weights: np.ndarray):
        self.features, self.scores, self.weights = features, scores, weights
        self.rate, self.scale = 1.0, 1.0
        self.at, self.probability = np.array([_LOW]), np.array([0.0])

    def word_scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.features) or not len(features):
            return np.full(len(features), -DRIFT)
        place = np.searchsorted(self.features, features.ravel()).clip(max=len(self.features) - 1)
        known = (self.features[place] == features.ravel()).reshape(features.shape)
        place = place.reshape(features.shape)
        best = np.where(known, self.weights[place], -1).argmax(axis=1)
        row = np.arange(len(features))
        return np.where(known[row, best], self.scores[place[row, best]], 0.0) - DRIFT

    def statistic(self, segments: list[float], n: int) -> float:
        """The largest over r of the sum statistic of the best r segments."""
        if not segments or not n:
            return _LOW
        chance, total, out = math.log(self.scale * n), 0.0, _LOW
        for r, score in enumerate(sorted(segments, reverse=True), 1):
            total += self.rate * score - chance + math.log(r)
            out = max(out, total)
        return min(out, _HIGH)

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(statistics, self.at, self.probability)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Candidates keep the totals before and after them; a new one joins the last candidate that
    starts lower, as long as that one's end is lower than its own.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.diff(np.concatenate([[0], positive.view(np.int8), [0]]))
    found: list[list] = []  # start, end, total before, total after, index of the last candidate with a lower start
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        new = [start, end, float(total[start]), float(total[end]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(s, e, after - before) for s, e, before, after, _ in found]


def _rows(piece: pa.RecordBatch, model: Model):
    content, bounds = B.flat(piece.column("text"))
    features, first, starts, ends = word_features(B.lower(content), bounds)
    scores = model.word_scores(features)
    for i in range(piece.num_rows):
        own = scores[first[i] : first[i + 1]]
        yield i, own, segments(own), starts[first[i] : first[i + 1]] - bounds[i], ends[first[i] : first[i + 1]] - bounds[i]


def _observe(model: Model):
    """Per training text its label, words and segments; per task the word scores of other texts, in bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        kind = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("found", pa.list_(pa.float64())), ("bin", pa.int64()), ("times", pa.int64())])
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                toxic, rows = piece.column("toxic").to_pylist(), []
                for i, own, found, _, _ in _rows(piece, model):
                    if not toxic[i]:
                        for b, k in zip(*(x.tolist() for x in np.unique(np.round(own / _BIN).astype(np.int64), return_counts=True)), strict=True):
                            seen[b] = seen.get(b, 0) + k
                    rows.append((toxic[i], len(own), [s for _, _, s in found]))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kind.types[:3], strict=True)]
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, none, none], schema=kind)
        if seen:
            n = len(seen)
            empty = [pa.nulls(n, t) for t in kind.types[:3]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], schema=kind)

    return run


def _rate(bins: dict[int, int]) -> float:
    """The positive lambda at which the mean of exp(lambda * score) over other texts' words is 1."""
    scores = np.array([b * _BIN for b in bins] + [1.0, 2.0, 4.0, 8.0])
    weights = np.array([float(n) for n in bins.values()] + [0.5] * 4)
    scores = np.where(scores == 0, -DRIFT, scores)
    weights /= weights.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if (weights * np.exp(np.minimum(middle * scores, 700))).sum() > 1 else (middle, high)
    return low


def _monotone(counts: dict[float, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing share of toxic texts by statistic: pools neighbours that are out of order."""
    pools: list[list[float]] = []
    for at in sorted(counts):
        ones, n = counts[at]
        pools.append([at, at, float(ones), float(n)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, o, k = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + o, pools[-1][3] + k]
    at = [x for p in pools for x in ((p[0], p[1]) if p[1] > p[0] else (p[0],))]
    share = [(p[2] + 0.02) / (p[3] + 0.1) for p in pools for _ in range(2 if p[1] > p[0] else 1)]
    return np.array(at), np.maximum.accumulate(np.clip(share, 0, 1))


def fit(training: DataFrame) -> Model:
    """Learns from all rows of ``training`` (text, toxic 0 or 1)."""
    training = training.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    # Copies are one text, with the larger of its labels.
    training = written(training.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "training")
    counts = training.mapInArrow(_count, "feature long, y1 long, y0 long").groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counts = written(counts, "features")
    n1, n0, n_features = counts.agg(F.sum("y1"), F.sum("y0"), F.count_if(F.col("y1") + F.col("y0") > 1)).first()
    if not n1 or not n0:
        return Model(np.zeros(0, _U), np.zeros(0), np.zeros(0))
    n, prior = float(n1 + n0), PRIOR * (n1 + n0)
    a = (F.col("y1") + F.col("y0")) / F.lit(n) * prior
    odds = lambda y, total: F.log((y + a) / (F.lit(float(total) + prior) - y - a))
    scored = counts.withColumn("d", odds(F.col("y1"), n1) - odds(F.col("y0"), n0)).withColumn("e", F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)))
    least_z = math.sqrt(2 * math.log(max(n_features, 2)))
    scored = scored.withColumn("z", F.abs(F.col("d") / F.col("e"))).filter(F.col("z") > least_z)
    best = scored.orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).select("feature", "d", "e", "z").toPandas()
    names = best["feature"].to_numpy(np.int64).view(_U)
    order = np.argsort(names)
    shrunk = np.sign(best["d"]) * (best["d"].abs() - 2 * best["e"])
    model = Model(names[order], shrunk.to_numpy(float)[order], best["z"].to_numpy(float)[order])

    seen = written(training.mapInArrow(_observe(model), "toxic int, n long, found array<double>, bin long, times long"), "observed")
    bins = {r["bin"]: r["times"] for r in seen.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("times").alias("times")).collect()}  # scores are bounded
    model.rate = _rate(bins)
    texts = seen.filter("toxic IS NOT NULL AND n > 0")
    top = F.coalesce(F.array_max("found"), F.lit(0.0))
    fitted = texts.filter("toxic = 0").agg(F.count("*").alias("k"), F.sum(F.col("n") * F.exp(-model.rate * top)).alias("s")).first()
    model.scale = float(fitted["k"] / fitted["s"]) if fitted["s"] else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [model.statistic(f or [], n) for f, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            at = np.round(np.array(at) / _STEP) * _STEP
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(at.astype(float))], names=["toxic", "at"])

    placed = texts.select("toxic", "n", "found").mapInArrow(place, "toxic int, at double")
    rows = placed.groupBy("at").agg(F.sum("toxic").alias("ones"), F.count("*").alias("n")).collect()  # one row a bin
    if rows:
        model.at, model.probability = _monotone({r["at"]: (r["ones"], r["n"]) for r in rows})
    return model


def _score(model: Model, with_passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                statistics, passages = [], []
                for _, own, found, starts, ends in _rows(piece, model):
                    statistics.append(model.statistic([s for _, _, s in found], len(own)))
                    if with_passages:
                        chance = [(s, e, x, model.scale * len(own) * math.exp(-model.rate * x)) for s, e, x in found]
                        passages.append([{"start": int(starts[s]), "end": int(ends[e - 1]), "score": x, "expected": p} for s, e, x, p in chance if p <= SIGNIFICANT])
                columns = [piece.column("doc_id"), pa.array(model.score(np.array(statistics)).astype(float))]
                names = ["doc_id", "score"]
                if with_passages:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
                    columns, names = [*columns, pa.array(passages, kind)], [*names, "passages"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score(docs: DataFrame, model: Model, with_passages: bool = False) -> DataFrame:
    """(doc_id, score[, passages]) per row of ``docs`` (doc_id, text); score is the probability that a text is toxic.

    passages: every maximal segment that chance would give at most SIGNIFICANT times in such a
    text, as byte offsets in its UTF-8 form.  Null and blank texts get the lowest score.
    Without labels of both kinds every score is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = ", passages array<struct<start:int,end:int,score:double,expected:double>>" if with_passages else ""
    return rows.mapInArrow(_score(model, with_passages), f"doc_id long, score double{more}")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of documents with a label; of several labels of one doc_id the more frequent, 1 in a tie."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return docs.select("doc_id", "text").join(small(one, F.lit(24)), "doc_id")
