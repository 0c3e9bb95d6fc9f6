"""Vectorised helpers over the lines of text columns: keys, character shingles, MinHash."""

from __future__ import annotations

import numpy as np

from .kernels import _BASE, _SPACE, U64, mix, word_hashes

BINS_LOG = 7
BINS = 1 << BINS_LOG


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines without outer whitespace, and the first line of each row.

    A row's text has one line more than newlines; an empty text has one empty line.
    """
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], cut + 1)))
    rows = np.searchsorted(cut, offsets[1:]) - np.searchsorted(cut, offsets[:-1]) + 1
    first = np.concatenate(([0], np.cumsum(rows)))
    ends = np.sort(np.concatenate((cut, offsets[1:])))
    _strip(data, starts, ends)
    return starts, ends, first


def _strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Moves starts and ends past outer whitespace, in place; a blank line becomes empty."""
    left = np.flatnonzero(starts < ends)
    for _ in range(8):
        left = left[_SPACE[data[starts[left]]]]
        starts[left] += 1
        left = left[starts[left] < ends[left]]
    right = np.flatnonzero(starts < ends)
    for _ in range(8):
        right = right[_SPACE[data[ends[right] - 1]]]
        ends[right] -= 1
        right = right[starts[right] < ends[right]]
    if len(left) or len(right):  # long runs of whitespace
        solid = np.append(np.flatnonzero(~_SPACE[data]), len(data))
        starts[left] = np.minimum(solid[np.searchsorted(solid, starts[left])], ends[left])
        right = right[starts[right] < ends[right]]
        ends[right] = solid[np.searchsorted(solid, ends[right]) - 1] + 1


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of lines (0 for blank ones)."""
    return np.where(ends > starts, word_hashes(data, starts, ends, lower=False), U64(0))


def _characters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each character, and the first and end characters of lines."""
    if not (data & 0x80).any():
        return data.astype(U64), starts, ends
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[heads].astype(U64)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    more = np.flatnonzero(code >= U64(0xC0))
    for j in range(1, 4):
        more = more[(padded[heads[more] + j] & 0xC0) == 0x80]
        code[more] = (code[more] << U64(8)) | padded[heads[more] + j]
    return code, np.searchsorted(heads, starts), np.searchsorted(heads, ends)


def _windows(code: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of the ``k`` characters from each place on, by doubling."""
    held, size, half, width = None, 0, code, 1
    while True:
        step = U64(pow(int(_BASE), width, 1 << 64))
        if k & width:
            held = half if held is None else held[: max(0, len(held) - width)] * step + half[size:]
            size += width
        if size == k:
            return held
        half = half[: max(0, len(half) - width)] * step + half[width:]
        width *= 2


def _finish(x: np.ndarray) -> np.ndarray:
    """Spreads polynomials over all bits, in place."""
    x ^= x >> U64(32)
    x *= U64(0x9FB21C651E98DF25)
    x ^= x >> U64(32)
    return x


def char_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of lines and the line of each; a shorter line is one shingle."""
    code, a, b = _characters(data, starts, ends)
    # a hash for each place, then those of places where a shingle of some line begins
    every = np.zeros(len(code), U64)
    if len(code) >= k:
        every[: len(code) - k + 1] = _finish(_windows(code, k) + U64(k))
    size = b - a
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        own = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = size[short] > j
            own[has] = own[has] * _BASE + code[a[short[has]] + j]
        every[a[short]] = _finish(own + size[short].astype(U64))
    count = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    line = np.repeat(np.arange(len(starts)), count)
    if (a[1:] >= b[:-1]).all():
        turn = np.zeros(len(code) + 1, np.int8)
        some = count > 0
        turn[a[some]] = 1
        turn[(a + count)[some]] -= 1
        return every[np.cumsum(turn[:-1], dtype=np.int8).view(bool)], line
    at = np.arange(count.sum()) + np.repeat(a - np.cumsum(count) + count, count)
    return every[at], line


def _donors() -> tuple[np.ndarray, np.ndarray]:
    """For each bin an order of all bins, itself first, and the rank of each bin in that order."""
    at = np.arange(BINS * BINS, dtype=U64)
    key = mix(at + U64(0x51ED27)).reshape(BINS, BINS)
    np.fill_diagonal(key, 0)
    order = np.argsort(key, 1, kind="stable")
    return order, np.argsort(order, 1, kind="stable").T.astype(np.uint8).copy()


_ORDER, _RANK = _donors()


def band_hashes(shingles: np.ndarray, line: np.ndarray, n: int, rows: int, bands: int) -> np.ndarray:
    """(n, bands) hashes of one-permutation MinHash signatures, empty bins filled from others.

    An empty bin takes the value of the first full one in its own random order of
    the bins, so bins of a line with few shingles are drawn independently.
    """
    empty = U64((1 << 64) - 1)
    flat = np.full(n * BINS, empty, U64)
    at = line * BINS
    at += (shingles >> U64(64 - BINS_LOG)).view(np.int64)
    np.minimum.at(flat, at, shingles)
    table = flat.reshape(n, BINS)
    full = table != empty
    held = full.sum(1)
    # lines with few empty bins: each of these goes along its order, a step for all at once
    void = ~full
    void[held < BINS // 4] = False
    void[:, rows * bands :] = False
    place = np.flatnonzero(void)
    bin_, full = place & (BINS - 1), full.ravel()
    step = 1
    while len(place):
        donor = place - bin_ + _ORDER[bin_, step]
        got = full[donor]
        flat[place[got]] = flat[donor[got]]
        place, bin_, step = place[~got], bin_[~got], step + 1
    full = full.reshape(n, BINS)
    # the others: the least rank among the full bins
    for size in np.unique(held[(held > 0) & (held < BINS // 4)]).tolist():
        same = np.flatnonzero(held == size)
        for lo in range(0, len(same), 1024):
            some = same[lo : lo + 1024]
            bins = np.nonzero(full[some])[1].reshape(len(some), size)
            rank = _RANK[bins[:, 0]]
            for i in range(1, size):
                np.minimum(rank, _RANK[bins[:, i]], out=rank)
            table[some] = np.take_along_axis(table[some], _ORDER[np.arange(BINS), rank], 1)
    salt = mix(np.arange(bands, dtype=U64) + U64(99))
    out = np.zeros((n, bands), U64)
    for r in range(rows):
        out = out * _BASE + table[:, r * bands : (r + 1) * bands]
    return mix(out + salt)
