"""A minimal acyclic transducer from terms to their lexicographic ordinals, as flat arrays.

``build`` adds sorted terms one by one and merges every finished suffix with an
equal one, so the automaton is minimal at any time. ``walk`` steps many terms at once through the
arrays: a state has 256 bits for the bytes that leave it, and the number of bits
below a byte gives the place of its transition; each transition carries how many
terms precede those behind it, and their sum along a path is the term's ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np


class Transducer(NamedTuple):
    bits: np.ndarray  # (states, 4) uint64: the bytes that leave a state
    place: np.ndarray  # (states, 4) int32: transitions before each of these words
    target: np.ndarray  # int32, by transition
    skip: np.ndarray  # int32, by transition: terms before those behind it
    final: np.ndarray  # bool, by state
    roots: np.ndarray  # int32, one for each vocabulary
    offset: np.ndarray  # int64, one for each vocabulary: its first term's place in ``ordinals``
    ordinals: np.ndarray  # int64: what each term stands for


def build(terms: Iterable[bytes]) -> Transducer:
    """The transducer of strictly ascending ``terms``; the ordinals count from 0."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []

    def settle(node: list) -> int:
        """The number of the state equal to ``node`` = [final, labels, targets]."""
        key = (node[0], bytes(node[1]), tuple(node[2]))
        at = known.get(key)
        if at is None:
            at = known[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[t] for t in node[2]))
        return at

    path: list[list] = [[False, bytearray(), []]]
    last, n = b"", 0
    for term in terms:
        if n and term <= last:
            raise ValueError("terms must ascend")
        shared = 0
        for a, b in zip(last, term):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            done = settle(path.pop())
            path[-1][2].append(done)
        for byte in term[shared:]:
            path[-1][1].append(byte)
            path.append([False, bytearray(), []])
        path[-1][0] = True
        last, n = term, n + 1
    while len(path) > 1:
        done = settle(path.pop())
        path[-1][2].append(done)
    root = settle(path[0])

    size = len(states)
    fans = np.fromiter((len(s[1]) for s in states), np.int64, size)
    of = np.repeat(np.arange(size), fans)
    label = np.frombuffer(b"".join(s[1] for s in states), np.uint8)
    target = np.fromiter((t for s in states for t in s[2]), np.int32, len(of))
    final = np.fromiter((s[0] for s in states), bool, size)
    bits = np.zeros((size, 4), np.uint64)
    np.bitwise_or.at(bits, (of, label >> 6), np.uint64(1) << (label & 63).astype(np.uint64))
    place = np.zeros((size, 4), np.int32)
    place.ravel()[1:] = np.cumsum(np.bitwise_count(bits).ravel())[:-1]
    # terms before a transition: the state's own end and all behind its earlier transitions
    behind = np.asarray(counts, np.int64)[target]
    before = np.cumsum(behind) - behind
    first = np.cumsum(fans) - fans
    skip = before - before[np.minimum(first, max(len(of) - 1, 0))][of] + final[of] if len(of) else before
    return Transducer(bits, place, target, skip.astype(np.int32), final, np.array([root], np.int32), np.zeros(1, np.int64), np.arange(n))


def union(parts: list[Transducer]) -> Transducer:
    """All vocabularies of ``parts`` side by side, each with its own root."""
    states = np.cumsum([0, *(len(p.final) for p in parts)])[:-1]
    edges = np.cumsum([0, *(len(p.target) for p in parts)])[:-1]
    terms = np.cumsum([0, *(len(p.ordinals) for p in parts)])[:-1]
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    moved = lambda name, by: np.concatenate([(getattr(p, name) + at).astype(getattr(p, name).dtype) for p, at in zip(parts, by)])
    return Transducer(
        join("bits"), moved("place", edges), moved("target", states), join("skip"),
        join("final"), moved("roots", states), moved("offset", terms), join("ordinals"),
    )


def walk(t: Transducer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places in ``t.ordinals`` of the spans of ``data``, each looked up in its own vocabulary; -1 where it holds none."""
    found = np.full(len(starts), -1, np.int64)
    live = np.flatnonzero(vocabulary >= 0)
    state, at, total, end = t.roots[vocabulary[live]], starts[live], t.offset[vocabulary[live]], ends[live]
    bits, place = t.bits.ravel(), t.place.ravel()
    while len(live):
        over = at == end
        if over.any():
            hit = over & t.final[state]
            found[live[hit]] = total[hit]
            go = ~over
            live, state, at, total, end = live[go], state[go], at[go], total[go], end[go]
        byte = data[at]
        cell = state.astype(np.int64) * 4 + (byte >> 6)
        held, shift = bits[cell], (byte & 63).astype(np.uint64)
        go = (held >> shift) & np.uint64(1) > 0
        if not go.all():
            live, at, total, end, cell, held, shift = live[go], at[go], total[go], end[go], cell[go], held[go], shift[go]
        edge = place[cell] + np.bitwise_count(held & ((np.uint64(1) << shift) - np.uint64(1)))
        state, total, at = t.target[edge], total + t.skip[edge], at + 1
    return found
