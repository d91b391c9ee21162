"""Text columns of Arrow batches as flat byte arrays, and the words in them.

Everything here works on one bounded piece of a batch at a time and on whole texts: a piece
ends after the document that fills it, so its size is bounded by ``PIECE_BYTES`` or by one
document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values drawn from a seed."""
    with np.errstate(over="ignore"):
        return splitmix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE_VALUE = random_words(256, 11)
_BASE = _U(0x9DDFEA08EB382D69)  # odd, so no byte is lost
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=_U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, kept from call to call."""
    global _powers
    if n > len(_powers):
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(max(n, 256) - 1, _BASE, dtype=_U))])
    return _powers[:n]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of a piece hold about ``limit`` bytes."""
    _, bounds = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts (one more entry than rows); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return content, bounds - bounds[0]


def lower(content: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[content]


def spans(keep: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of kept bytes; no run crosses a row."""
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(keep) + 1, dtype=bool)
    first[bounds] = True
    begins = keep.copy()
    begins[1:] &= ~keep[:-1] | first[1:-1]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:] | first[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(content: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+``, and the index of each row's first word."""
    starts, ends = spans(~_BLANK[content], bounds)
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(content: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are sorted and do not overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        lengths = ends - starts
        total = np.zeros(len(content) + 1, _U)
        place = np.zeros(len(content), np.int64)
        place[starts] = starts
        place = np.arange(len(content)) - np.maximum.accumulate(place)
        longest = int(lengths.max())
        table = _BYTE_VALUE if not seed else random_words(256, 11 + seed)
        # Bytes between spans get a power as well; the difference of sums leaves them out.
        np.cumsum(table[content] * powers(longest)[np.minimum(place, longest - 1)], out=total[1:])
        return splitmix((total[ends] - total[starts]) ^ (lengths.astype(_U) * _U(0x9E3779B97F4A7C15)))


_STEP = _U(0xD1342543DE82EF95)
_STEP_BACK = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:end]``; runs may overlap."""
    with np.errstate(over="ignore"):
        n = len(values)
        ahead = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, _STEP, _U))])
        back = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, _STEP_BACK, _U))])
        total = np.concatenate([np.zeros(1, _U), np.cumsum(values * ahead[:n])])
        return splitmix((total[ends] - total[starts]) * back[starts] ^ ((ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)))
