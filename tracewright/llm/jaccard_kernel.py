"""Signatures of the universe-partition pigeonhole for sets of hashed tokens.

Let H be the largest symmetric difference of two linked sets: with a required
Jaccard similarity of ``num/den`` and sizes x, y it is
``floor((x + y) * (den - num) / (den + num))``. A size band splits the hash
universe into m segments. Two linked sets differ in at most H segments, so
among the first H + 1 non-empty segments of either set (in an order that
depends on a segment's content alone) lies one that both sets share.

Allocation. A segment made of popular tokens only has a long list behind it,
so it gets 0; other segments get 1. A set with at most H segments of the
second kind can be missed by these only together with a partner that has as
few, so just such sets also emit, over their rare tokens, every segment with
its one-deletion neighbours (allocation 2 where the segment has two tokens or
more). Where even those allocations sum to at most H, the set also emits
segments of one token: its first ``n - required + 1`` tokens, rare ones first.
"""

from __future__ import annotations

import numpy as np

from .kernels import U64, mix


class Bands:
    """Size bands for one similarity ``num/den``; a pair belongs to the band of its smaller set."""

    #: Largest size of a band over that of the band before: the wider, the fewer sets emit for two bands.
    RATIO = 2

    def __init__(self, num: int, den: int, segment_tokens: float = 2.0, top: int = 1 << 40):
        self.num, self.den, self.tokens = num, den, segment_tokens
        tops = [0]
        while tops[-1] < top:
            tops.append(max(tops[-1] + 1, tops[-1] * den // num, tops[-1] * self.RATIO))
        self.tops = np.array(tops[1:], np.int64)

    def difference(self, x: int, y: int) -> int:
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, largest difference) of each band that may hold a partner or the set itself."""
        own = int(np.searchsorted(self.tops, n))
        found = []
        b = own
        while b >= 0 and int(self.tops[b]) * self.den >= self.num * n:
            top = int(self.tops[b])
            h = self.difference(n, n * self.den // self.num) if b == own else self.difference(n, min(top, n))
            found.append((b, max(1, int(np.ceil(top / self.tokens))), h))
            b -= 1
        return found


_KEY = np.arange(1, 1 << 8, dtype=U64)


def _segments(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each non-empty segment in sorted tokens, and the segment numbers."""
    seg = ((tokens >> U64(32)) * U64(m)) >> U64(32)
    at = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return at, seg[at]


def signatures(tokens: np.ndarray, bands: Bands, popular: np.ndarray) -> np.ndarray:
    """Signature hashes of one set of sorted distinct tokens. ``popular``: sorted tokens."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, U64)
    mixed = mix(tokens + U64(0x51ED270B))
    if len(popular):
        at = np.minimum(np.searchsorted(popular, tokens), len(popular) - 1)
        rare = popular[at] != tokens
    else:
        rare = np.ones(n, bool)
    rest = None if rare.all() else tokens[rare]
    out = []
    poor = False
    for band, m, h in bands.of(n):
        at, seg = _segments(tokens, m)
        content = mix(np.add.reduceat(mixed, at) + seg * U64(0x9E3779B97F4A7C15) + U64(band * 4 + 1))
        if rest is not None:
            content = content[np.logical_or.reduceat(rare, at)]
        if len(content) > h:
            out.append(np.partition(content, h)[: h + 1] if len(content) > h + 1 else content)
            continue
        out.append(content)
        served = 0
        if rest is None:
            rest = tokens
        if len(rest):
            own = mixed if len(rest) == n else mixed[rare]
            at, seg = _segments(rest, m)
            sums = np.add.reduceat(own, at)
            salt = seg * U64(0x9E3779B97F4A7C15) + U64(band * 4 + 2)
            size = np.diff(np.append(at, len(rest)))
            served = int(np.minimum(size, 2).sum())
            several = np.repeat(size > 1, size)
            out.append(mix(sums + salt))
            out.append(mix(np.repeat(sums + salt, size) - own)[several])
        poor |= served <= h
    if poor:
        first = n - -(-bands.num * n // bands.den) + 1
        order = np.lexsort((mixed, ~rare))[:first]
        out.append(mix(mixed[order] + U64(3)))
    return np.concatenate(out)
