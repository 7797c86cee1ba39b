"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  Each word
gets a 64-bit polynomial hash read off one running sum, so no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer document is one slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (_MULTIPLIER, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, spans: bool = False):
    """Word hashes of the documents between ``offsets``, and the n + 1 places where each document's begin.

    With ``spans``, also each word's first and last byte, counted from the first document's start.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = data[lo:hi]
    at = offsets - lo
    n = len(text)
    if not n:
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(at), np.int64), *((empty, empty) if spans else ()))
    inside = _IS_WORD[text]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    size = 1 << max(20, int(n).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[text] * power[:n], out=total[1:])
    h = (total[end + 1] - total[start]) * inverse[start]
    h = mix64(h + (end - start + 1).astype(np.uint64) * U64(0xA24BAED4963EE407))
    bounds = np.searchsorted(start, at)
    return (h, bounds, start, end) if spans else (h, bounds)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words in ``h``, document borders ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _PLACE[0]
    for j in range(1, k):
        total += h[j : n + j] * _PLACE[j]
    return mix64(total + U64(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-word shingles; with fewer words the whole sequence, without any none."""
    h, bounds = words(data, offsets)
    runs = windows(h, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield s
        else:
            yield windows(h[a:b], b - a) if b > a else runs[:0]
