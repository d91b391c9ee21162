"""Language of whole texts by hyperdimensional profiles.

Every letter (code point) has a random vector of ``DIM`` signs.  An n-gram is the product of
its letters' vectors, each shifted by its place; a text is the sum over its n-grams, a
language the sum over its training texts, and a text gets the language of the largest cosine.
Words are lower-cased runs of letters with one blank at each end; n-grams do not cross
them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buffers as B

_U = np.uint64
DIM = 1024
GRAM = 3
MAX_LANGUAGES = 4096  # prototypes are sent to every task: 4 KB each
UNDETERMINED = "und"
_BLANK = 32
_POINTS = 0x110000
_fold: np.ndarray | None = None


def letters_of(points: np.ndarray) -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter; looked up once per code point."""
    global _fold
    if _fold is None:
        _fold = np.full(_POINTS, -1, np.int32)
    new = np.unique(points[_fold[points] < 0])
    for point in new.tolist():
        small = chr(point).lower() if unicodedata.category(chr(point))[0] == "L" else "\0"
        _fold[point] = ord(small[0])
    return _fold[points]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The sign vectors of the given code points, drawn from the code point alone."""
    with np.errstate(over="ignore"):
        lanes = B.random_words(DIM // 64, 23)
        bits = B.splitmix(B.splitmix(points.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))[:, None] ^ lanes)
        signs = np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1)
    return signs.astype(np.float32) * 2 - 1


def grams(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of a piece (21 bits a letter) and the row of each."""
    points = np.frombuffer(content.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    # A row starts at its first byte, so count the bytes that begin a code point before it.
    starts = np.concatenate([[0], np.cumsum((content & 0xC0) != 0x80)])[bounds]
    letters = letters_of(points)
    begins, ends = B.spans(letters > 0, starts)
    if not len(begins):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    # Each word with a blank before and after it, back to back.
    lengths = ends - begins + 2
    places = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), _BLANK, np.uint32)
    inside = np.ones(len(padded), bool)
    inside[places] = inside[places + lengths - 1] = False
    padded[inside] = letters[letters > 0]
    word = np.repeat(np.arange(len(begins)), lengths)
    codes = np.zeros(len(padded) - GRAM + 1, _U)
    for i in range(GRAM):
        codes = (codes << _U(21)) | padded[i : len(padded) - GRAM + 1 + i].astype(_U)
    whole = word[: len(codes)] == word[GRAM - 1 :]
    rows = np.searchsorted(starts, begins, side="right") - 1
    return codes[whole], rows[word[: len(codes)][whole]]


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Product of the letters' vectors, the i-th letter's shifted by i places."""
    out = np.ones((len(codes), DIM), np.float32)
    for i in range(GRAM):
        points, which = np.unique((codes >> _U(21 * (GRAM - 1 - i))) & _U((1 << 21) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(points), i, axis=1)[which]
    return out


def bundles(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One summed vector a row, and its number of n-grams: 0 without a letter."""
    codes, rows = grams(content, bounds)
    n = len(bounds) - 1
    known, which = np.unique(codes, return_inverse=True)
    out = np.zeros((n, DIM), np.float32)
    for k in range(0, len(known), 4096):  # bounds the vectors held at once
        chosen = (which >= k) & (which < k + 4096)
        width = min(4096, len(known) - k)
        counts = np.bincount(rows[chosen] * width + which[chosen] - k, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ gram_vectors(known[k : k + width])
    return out, np.bincount(rows, minlength=n)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for piece in B.pieces(batch, "text", 1 << 20):
            yield (piece, *B.flat(piece.column("text")))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums n-gram counts by language over all texts of a task, then binds them once."""
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    done: dict[str, np.ndarray] = {}

    def settle(lang: str) -> None:
        codes, n = counts.pop(lang)
        total = done.setdefault(lang, np.zeros(DIM, np.float64))
        for k in range(0, len(codes), 4096):
            total += n[k : k + 4096].astype(np.float64) @ gram_vectors(codes[k : k + 4096])

    for piece, content, bounds in _texts(batches):
        codes, rows = grams(content, bounds)
        langs = piece.column("lang").dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        of_gram = of_row[rows]
        for i, lang in enumerate(names):
            own, n = np.unique(codes[of_gram == i], return_counts=True)
            if lang in counts:
                both = np.concatenate([counts[lang][0], own])
                own, which = np.unique(both, return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([counts[lang][1], n])).astype(np.int64)
            counts[lang] = (own, n)
            if len(own) > 1 << 18:
                settle(lang)
    for lang in list(counts):
        settle(lang)
    if done:
        yield pa.RecordBatch.from_pydict({"lang": list(done), "profile": [v.tolist() for v in done.values()]})


def profiles(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors from all rows of ``training`` (text, lang); null in either teaches nothing.

    A task sends one vector a language, added up by place; MAX_LANGUAGES bounds what the
    driver gets.  More languages than that are an error, not a cut.
    """
    rows = training.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    parts = rows.mapInArrow(_learn, "lang string, profile array<double>")
    sums = parts.select("lang", F.posexplode("profile").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    found = sorted(vectors.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return [], np.zeros((0, DIM), np.float32)
    matrix = np.array([r["v"] for r in found])
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in found], (matrix / np.where(lengths > 0, lengths, 1)).astype(np.float32)


def _predict(langs: list[str], matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, content, bounds in _texts(batches):
            vectors, n_grams = bundles(content, bounds)
            some = n_grams > 0
            lengths = np.linalg.norm(vectors, axis=1)
            names, scores = np.full(piece.num_rows, UNDETERMINED, object), np.zeros(piece.num_rows)
            if langs:
                cosines = vectors @ matrix.T / np.where(lengths > 0, lengths, 1)[:, None]
                best = cosines.argmax(axis=1)
                names = np.where(some, np.array(langs, object)[best], UNDETERMINED)
                scores = np.where(some, cosines.max(axis=1).clip(0, 1), 0.0)
            rest = [piece.column(c) for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names.tolist(), pa.string()), pa.array(scores.astype(float))],
                names=[*(c for c in piece.schema.names if c != "text"), "lang_pred", "score"],
            )

    return run


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; a null key counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), learned from ``training`` (text, lang).

    score is the cosine with the language's profile, at least 0.  Null texts, texts without a
    letter, and all texts if nothing was learned, get 'und' and 0.  Ties go to the smaller
    name.  Rows are kept one for one, repeated and null doc_id included.
    """
    langs, matrix = profiles(training)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_predict(langs, matrix), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang and any others) whose text has a language; learns from all rows with a lang.

    A text without a letter has none.  If no row teaches a language, every text with a letter stays.
    """
    langs, matrix = profiles(docs)
    if not langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(_predict(langs, matrix), schema)
    return found.filter(F.col("lang_pred") != UNDETERMINED).select("row.*")
