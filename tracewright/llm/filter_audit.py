"""Operator 13: what each filter removes in each order of five, and what it costs.

One pass of a byte transducer reads every text. Its state says whether the last
byte was inside a word; the entry of (state, byte) in ``STEPS`` holds the next
state and what the byte emits: the start or end of a word, a capital, a code point
(any byte but a continuation of UTF-8), a symbol. The state after a byte follows from that byte alone,
so a whole chunk steps at once. The word spans go into a hash table with open
addressing, where a span takes a slot or equals its owner byte by byte, or moves
on; spans that took a slot are the distinct words of their texts.

The documents become narrow rows (id, digest of the text, failed filters) that
are added up before every exchange: rows of one id and text, then rows of one
text. Texts are equal if their SHA-256 digests are. What is left, rows by part,
set of failed filters and labels, is at most 128 for each part, and only these
meet the 600 steps of all orders.

Defined results: a null text is empty and a null language the empty part; of rows
with one text those of the smallest id are first, all others repeat it; a null id
is neither smaller nor larger than another, so its row repeats nothing and is not
repeated; a label is 1 if any row of the id has 1; a part has all 600 rows, a
table without rows none. Other columns are left aside.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .common import materialize

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
NEXT, BEGINS, ENDS, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16, 32
STATISTICS = ["words", "distinct", "capitals", "points", "symbols"]


def transducer() -> np.ndarray:
    """Entry ``state * 256 + byte``: the next state (1: in a word) and what the byte emits."""
    steps = np.zeros((2, 256), np.uint8)
    for byte in range(256):
        space = byte == 0x20 or 0x09 <= byte <= 0x0D
        emits = POINT * (byte & 0xC0 != 0x80) | CAPITAL * (0x41 <= byte <= 0x5A) | SYMBOL * (byte in SYMBOLS)
        steps[0, byte] = emits | (0 if space else NEXT | BEGINS)
        steps[1, byte] = emits | (ENDS if space else NEXT)
    return steps.ravel()


STEPS = transducer()


def same_spans(data: np.ndarray, at: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes at ``at`` equal those at ``other``, for spans of one length each, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    equal, live, done = np.ones(len(at), bool), np.arange(len(at)), 0
    while len(live):
        left = np.minimum(length[live] - done, 8)
        inside = np.arange(8) < left[:, None]
        differ = ((windows[at[live] + done] != windows[other[live] + done]) & inside).any(axis=1)
        equal[live[differ]] = False
        done += 8
        live = live[~differ & (length[live] > done)]
    return equal


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Marks the first span of each (row, bytes)."""
    n = len(starts)
    fresh = np.zeros(n, bool)
    slots = 1 << max(n * 2, 2).bit_length()
    slot = (K.mix(K.word_hashes(data, starts, ends, False) + row.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) & K.U64(slots - 1)).astype(np.int64)
    owner = np.full(slots, -1, np.int64)
    waiting = np.arange(n)
    while len(waiting):
        free = waiting[owner[slot[waiting]] < 0]
        owner[slot[free][::-1]] = free[::-1]  # the earliest of those that reach a free slot takes it
        holder = owner[slot[waiting]]
        took = holder == waiting
        fresh[waiting[took]] = True
        waiting, holder = waiting[~took], holder[~took]
        length = ends[waiting] - starts[waiting]
        equal = (row[waiting] == row[holder]) & (length == ends[holder] - starts[holder])
        equal[equal] = same_spans(data, starts[waiting[equal]], starts[holder[equal]], length[equal])
        waiting = waiting[~equal]
        slot[waiting] = (slot[waiting] + 1) & (slots - 1)
    return fresh


def count_bytes(column: pa.Array) -> np.ndarray:
    """Rows of (words, distinct words, capitals, code points, symbols)."""
    out = np.zeros((len(column), 5), np.int64)
    for lo, hi, data, offsets in K.chunks(column):
        if len(data) == 0:
            continue
        state = np.zeros(len(data), np.uint16)
        state[1:] = (STEPS[data[:-1]] & NEXT).astype(np.uint16) << 8
        state[offsets[:-1][offsets[:-1] < len(data)]] = 0  # every text starts outside a word
        step = STEPS[state | data]
        # a word that its text's end closes has no byte that emits its end
        open_end = np.zeros(len(data) + 1, bool)
        open_end[offsets[1:][offsets[1:] > 0]] = True
        open_end[1:] &= (step & NEXT) > 0
        closes = open_end
        closes[:-1] |= (step & ENDS) > 0
        starts, ends = np.flatnonzero(step & BEGINS), np.flatnonzero(closes)
        first = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        out[lo:hi, 0] = np.diff(first)
        out[lo:hi, 1] = np.bincount(row[distinct_spans(data, starts, ends, row)], minlength=hi - lo)
        for j, kind in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            found = np.flatnonzero(step & kind)
            out[lo:hi, j] = np.diff(np.searchsorted(found, offsets))
    return out


def text_statistics(text) -> F.Column:
    """Counts of one pass over each text: words, distinct words, capitals, code points, symbols."""

    @F.arrow_udf(StructType([StructField(x, LongType()) for x in STATISTICS]))
    def read(texts: pa.Array) -> pa.Array:
        counts = count_bytes(texts)
        return pa.StructArray.from_arrays([pa.array(counts[:, j]) for j in range(len(STATISTICS))], STATISTICS)

    return read(text)


def failed_filters(s) -> F.Column:
    """Bits of the filters A to D that a text with statistics ``s`` fails."""
    fails = [
        s["words"] < 100,
        100 * s["distinct"] < 80 * s["words"],
        100 * s["capitals"] > 10 * s["points"],
        s["symbols"] > 0,
    ]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0)).cast("int")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, key, fails, n): rows of one id, part and text, the digest of the text, failed filters A to D."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text_statistics(text).alias("s"))
    return read.select("id", "part", "key", failed_filters(F.col("s")).alias("fails")).groupBy("id", "part", "key", "fails").agg(F.count(F.lit(1)).alias("n"))


def failure_classes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, good, toxic, n): all five filters and the labels, one row for each class of documents."""
    rows = materialize(failures(docs, id_col, text_col, part_col), "failures")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    mark = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    marked = rows.where("id is not null").join(known, "id", "left").select("id", "part", "key", "fails", "n", mark("good"), mark("toxic"))
    bare = rows.where("id is null").select("id", "part", "key", "fails", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # rows of one text, added up by part and labels, with the smallest id and how many rows have it
    kinds = marked.unionByName(bare).groupBy("key", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    is_first = F.col("least.id") == F.min("least.id").over(Window.partitionBy("key"))
    kinds = kinds.withColumn("kept", F.col("n_null") + F.when(is_first, F.col("least.n")).otherwise(0))
    repeat = 1 << FILTERS.index("E")
    both = F.inline(F.array(F.struct(F.col("fails"), F.col("kept").alias("n")), F.struct((F.col("fails") + repeat).alias("fails"), (F.col("n") - F.col("kept")).alias("n"))))
    return kinds.select("part", "good", "toxic", both).where("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the filter) of all orders."""
    out = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step, before, bit))
            before |= bit
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with what the step's filter removes."""
    classes = failure_classes(docs, labels, id_col, text_col, part_col)
    step = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit")) for o, s, b, f in orders()))
    rows = classes.select("part", "fails", "good", "toxic", "n", F.inline(step))
    fails, before, bit = F.col("fails"), F.col("before"), F.col("bit")
    passed, hit = fails.bitwiseAND(before) == 0, fails.bitwiseAND(bit) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    # of all orders, one in as many as a document fails filters has this filter first among them
    rows = rows.withColumn("share", F.col("n") * F.expr(f"{len(orders()) // len(FILTERS)} div greatest(bit_count(fails), 1)"))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(passed & ~hit).alias("kept"),
        total(passed & hit).alias("removed"),
        total(~passed & hit).alias("redundant"),
        total(fails == bit).alias("unique_fails"),
        total(passed & hit & (F.col("good") == 1)).alias("good_lost"),
        total(passed & hit & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(hit, "share").alias("shapley"),
    )
