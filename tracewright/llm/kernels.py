"""Vectorised numpy helpers over Arrow text columns: words, hashes, shingles.

A chunk is a run of whole rows of about ``CHUNK`` bytes, so that memory does
not follow the size of an Arrow batch; a longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for base in (_BASE, _BACK):
            steps = np.full(size, base, U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        if n > 4 * CHUNK:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a text column, about ``size`` bytes each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and the first word of each row (n + 1 values)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes (``lower``: A-Z lower-cased first)."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    power, back = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def gram_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words that start at each word (rows are not looked at)."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashed[j : j + n] * U64((2 * j + 3) * 0x2545F4914F6CDD1D % (1 << 64) | 1)
    return mix(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times faster than the hash table behind ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_set(hashed: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of one row's word hashes; fewer words make one shingle."""
    if len(hashed) == 0:
        return hashed
    if len(hashed) < k:
        return mix(gram_hashes(hashed, len(hashed)) + U64(len(hashed)))
    return distinct(gram_hashes(hashed, k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
