"""Operator 12: token counts of texts by merging byte pairs, without token ids.

A text is cut at its special strings, each of which is one token, and between
them into pieces by the vocabulary's pattern. A piece starts as one symbol for
each byte in a linked list; a heap gives the adjacent pair of lowest rank (the
leftmost of equal ones), the pair becomes one symbol and its new neighbours enter
the heap, until no pair has a rank. Each merge leaves one symbol fewer, so the
count is the number of bytes less the number of merges: n log n steps for a piece
of n bytes, however long it is.

The ranks are read once from the vocabulary's file, at most ``MAX_MERGES``, and
broadcast; texts stay where they are and nothing is shuffled. Each task remembers
counts of at most ``REMEMBERED`` short pieces.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
and rows without an id each give their row; an empty table gives none; malformed
UTF-8 counts as its replacement characters. Only named columns are kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of byte-level vocabularies.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A broadcast list of merges is not longer than this.
MAX_MERGES = 1 << 20
REMEMBERED = 1 << 18
SHORT = 48


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_merges(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of symbol pairs and the special strings of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in held["model"]["merges"]]
    if len(pairs) > MAX_MERGES:
        raise ValueError(f"{len(pairs)} merges are more than {MAX_MERGES}")
    return {pair: rank for rank, pair in enumerate(pairs)}, [x["content"] for x in held.get("added_tokens", [])]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the pairs of ``symbols`` are merged in order of rank."""
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # an entry is stale if its symbol is gone or has another neighbour by now
        if j >= n or not symbols[i] or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = ranks.get((symbols[i], symbols[k]))
            if found is not None:
                heapq.heappush(heap, (found, i))
        h = before[i]
        if h >= 0:
            found = ranks.get((symbols[h], symbols[i]))
            if found is not None:
                heapq.heappush(heap, (found, h))
    return left


class PieceCounts(dict):
    """Token counts of pieces; those of short ones are remembered."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.symbols = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        n = merged_length([self.symbols[b] for b in piece.encode("utf-8", "replace")], self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


def text_counter(ranks: dict[tuple[str, str], int], special: list[str]):
    """A function from a text to its number of tokens."""
    count = PieceCounts(ranks)
    pieces = regex.compile(PIECE).findall
    # the longest of several special strings that start at one place
    cut = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None

    def of(text: str) -> int:
        if cut is None:
            return sum(map(count.__getitem__, pieces(text)))
        parts = cut.split(text)
        return len(parts) - 1 + sum(sum(map(count.__getitem__, pieces(x))) for x in parts)

    return of


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is the path of a byte-level BPE file on the driver."""
    held = docs.sparkSession.sparkContext.broadcast(read_merges(vocabulary))

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = text_counter(*held.value)
        for text in texts:
            yield pd.Series([of(x) if x else 0 for x in text], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(F.make_valid_utf8(text)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
