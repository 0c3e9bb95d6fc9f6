"""Operator 9: chat rendering after cumulative snapshots are collapsed.

Logs often hold a conversation again and again as it grows. Every turn gets two
64-bit hashes of its position, role and text; their running XOR over a
conversation is the hash of each turn prefix. A conversation whose full hash is
the hash of a proper prefix of another one is dropped by an anti-join, of equal
ones the least id stays, and only the conversations left are rendered.

Running sums are built over blocks of ``BLOCK`` turns and then over the blocks of
a conversation, so a very long conversation is not one task's window.

Defined results: turns are ordered by number, then role and text (nulls first);
gaps do not matter; a null role renders as an empty role, a null text as an
empty text, and both differ from empty ones in comparisons; rows without a
conversation id are left out, as they name no conversation; repeated rows are
turns of their own; an empty table gives no rows. Only the four named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1024


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``turns(conv, turn, role, text)`` with ``place`` from 1 and the prefix hashes ``p1``, ``p2``."""
    block = F.floor(F.col("turn") / BLOCK)
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    inside = Window.partitionBy("conv", "block").orderBy(*order)
    t = turns.withColumn("block", block).withColumn("at", F.row_number().over(inside))
    sizes = t.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("conv", F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    t = t.join(start, (t["block"].eqNullSafe(start["b"])) & (t["conv"] == start["conv"])).drop(start["conv"]).drop("b")
    place = F.col("start") + F.col("at")
    said = lambda seed: F.xxhash64(F.lit(seed), place, F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    t = t.withColumns({"place": place, "h1": said(1), "h2": said(2)})
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"x1": F.bit_xor("h1").over(sofar), "x2": F.bit_xor("h2").over(sofar)})
    blocks = t.groupBy("conv", "block").agg(F.bit_xor("h1").alias("y1"), F.bit_xor("h2").alias("y2"))
    zero = F.lit(0).cast("long")
    base = blocks.select("conv", F.col("block").alias("b"), F.coalesce(F.bit_xor("y1").over(earlier), zero).alias("y1"), F.coalesce(F.bit_xor("y2").over(earlier), zero).alias("y2"))
    t = t.join(base, (t["block"].eqNullSafe(base["b"])) & (t["conv"] == base["conv"])).drop(base["conv"])
    return t.select("conv", "turn", "role", "text", "place", F.col("x1").bitwiseXOR(F.col("y1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("p2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_same) of the conversations that no longer one begins with."""
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("place", "p1", "p2")).alias("e"))
    ends = ends.select("conv", F.col("e.place").alias("place"), F.col("e.p1").alias("p1"), F.col("e.p2").alias("p2"))
    last = ends.select(F.col("conv").alias("c"), F.col("place").alias("n"))
    inner = prefixes.select("conv", "place", "p1", "p2").join(last, F.col("conv") == F.col("c")).where("place < n")
    inner = inner.select("place", "p1", "p2").distinct()
    kinds = ends.groupBy("place", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_same"))
    return kinds.join(inner, ["place", "p1", "p2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_same")


def render_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, rendered) of each maximal conversation, in ChatML form."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    prefixes = materialize(turn_prefixes(turns), "turns")
    kept = maximal_conversations(prefixes)
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    left = prefixes.join(kept, "conv", "left_semi").select("conv", F.struct("place", said.alias("s")).alias("s"))
    # one rendered text is one value of the result, so its turns meet in one row
    text = left.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["s"]), "").alias("rendered"))
    return kept.join(text, "conv").select(F.col("conv").alias("conv_id"), "n_turns", "n_same", "rendered")
