"""Locally consistent parsing of word sequences by recompression.

A round names maximal runs of one symbol, then pairs of adjacent symbols whose
hashed classes are (left, right). Names are content hashes, so all tasks give
equal runs and pairs the same name without an exchange. Each symbol carries the
range of words that its parse depends on; wherever those words occur again, the
same symbol stands at the same place.
"""

from __future__ import annotations

import numpy as np

from .kernels import U64, mix

ROUNDS = 3
_FAR = 1 << 40


def _runs(sym, row, start, lo, hi):
    n = len(sym)
    new = np.ones(n, bool)
    new[1:] = (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], n) - 1
    size = b - a + 1
    name = np.where(size > 1, mix(sym[a] + size.astype(U64) * U64(0xA0761D6478BD642F)), sym[a])
    left, right = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
    has_left = (a > 0) & (row[left] == row[a])
    has_right = (b < n - 1) & (row[right] == row[a])
    low = np.where(has_left, np.minimum(lo[left], lo[a]), -_FAR)
    high = np.where(has_right, np.maximum(hi[right], hi[b]), _FAR)
    return name, row[a], start[a], low, high


def _pairs(sym, row, start, lo, hi, turn):
    n = len(sym)
    right = (mix(sym + U64((turn + 1) * 0xE7037ED1A0B428DB % (1 << 64))) & U64(1)).astype(bool)
    same = np.zeros(n + 1, bool)  # symbol i and the one before it are of one row
    same[1:n] = row[1:] == row[:-1]
    head = np.zeros(n, bool)
    head[:-1] = ~right[:-1] & right[1:] & same[1:n]
    tail = np.zeros(n, bool)
    tail[1:] = head[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    near = np.where(right, before, after)
    has_near = np.where(right, same[:n], same[1:])
    low = np.where(has_near, np.minimum(lo, lo[near]), -_FAR)
    low = np.where(right | has_near, low, lo)
    high = np.where(has_near, np.maximum(hi, hi[near]), _FAR)
    high = np.where(~right | has_near, high, hi)
    name = sym.copy()
    at = np.flatnonzero(head)
    name[at] = mix(sym[at] * U64(0x8EBC6AF09C88C6E3) + mix(sym[at + 1] + U64(turn + 77)))
    keep = ~tail
    return name[keep], row[keep], start[keep], low[keep], high[keep]


def anchors(hashed: np.ndarray, row: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of windows that share an anchor: (window start, windows, name).

    The windows are all runs of ``width`` words of one row. A window's anchor is
    its interior symbol of the highest round, then of the least name, then the
    leftmost; so equal windows have equal anchors at equal offsets. A unit is a
    run of consecutive windows with one anchor. ``row`` numbers the row of each
    word; ``first`` holds the first word of each row and the number of words.
    """
    n = len(hashed)
    windows = np.zeros(n + 1, bool)
    counts = np.diff(first)
    long = counts >= width
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    np.logical_not(windows, out=windows)
    windows[n] = False
    for r in np.flatnonzero(~long):
        windows[first[r] : first[r + 1]] = False
    tails = first[1:][long][:, None] - np.arange(1, width)
    windows[tails.ravel()] = False
    level = (hashed, row, np.arange(n), np.arange(n), np.arange(1, n + 1))
    levels = [level]
    for turn in range(ROUNDS):
        level = _pairs(*_runs(*level), turn)
        levels.append(level)
    winner = np.full(n, -1, np.int64)
    names = np.zeros(n, U64)
    open_ = windows[:n].copy()
    for depth in range(ROUNDS, -1, -1):
        sym, _, start, lo, hi = levels[depth]
        from_, to = hi - width, lo  # window starts that hold the whole context
        ok = np.flatnonzero((from_ <= to) & (hi < _FAR) & (lo > -_FAR))
        from_, to = np.maximum(from_[ok], 0), np.minimum(to[ok], n - 1)
        left = np.concatenate(([0], np.cumsum(open_)))
        some = (left[to + 1] > left[from_]) & (to >= from_)
        ok, from_, to = ok[some], from_[some], to[some]
        size = to - from_ + 1
        entry = np.repeat(np.arange(len(ok)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + from_[entry]
        use = open_[at]
        at, entry = at[use], entry[use]
        name = mix(sym[ok] + U64(depth + 11))
        best = np.zeros(n, U64)
        np.maximum.at(best, at, ~name[entry])
        won = ~name[entry] == best[at]
        at, entry = at[won][::-1], entry[won][::-1]  # the leftmost is written last
        winner[at] = start[ok][entry] * (ROUNDS + 1) + depth
        names[at] = name[entry]
        open_[at] = False
        if not open_.any():
            break
    p = np.flatnonzero(windows[:n])
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1] + 1) | (winner[p[1:]] != winner[p[:-1]]) | (row[p[1:]] != row[p[:-1]])
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(p)))
    return p[at], size, names[p[at]] + mix(U64(5) + (winner[p[at]] & 3).astype(U64))
