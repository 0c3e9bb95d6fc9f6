"""Operator 3: contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by id; per-partition totals (one row each) give every
partition its offset, a running sum inside the partition gives every row its
global byte position, and the row belongs to the shard whose equal share of all
bytes holds its midpoint. So shards are contiguous in id order and differ from
the target by less than one row at either end.

Defined results: a null text counts ``overhead`` bytes; null ids sort last; rows
with equal ids are ordered by checksum and size, and equal rows are
interchangeable; an empty table gives no rows. Only named columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions


def text_bytes(text) -> F.Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def assign_shards(rows: DataFrame, shards: int, size_col: str, order_cols: list[str]) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``rows`` should be narrow: it is shuffled once and written once. Sizes must
    be positive. ``order_cols`` give the order; columns named ``shard``, ``slot``
    or starting with ``_ps_`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot").withColumn("_ps_tie", F.monotonically_increasing_id())
    order = [*(F.col(c).asc_nulls_last() for c in order_cols), F.col("_ps_tie").asc()]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_ps_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    # one row for each partition: these totals are all that is ordered in one place
    totals = dealt.groupBy("_ps_part").agg(F.sum(size_col).alias("_ps_sum"), F.count(F.lit(1)).alias("_ps_n"))
    before = Window.orderBy("_ps_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "_ps_part",
        F.coalesce(F.sum("_ps_sum").over(before), F.lit(0)).alias("_ps_from"),
        F.coalesce(F.sum("_ps_n").over(before), F.lit(0)).alias("_ps_row"),
        F.sum("_ps_sum").over(everything).alias("_ps_all"),
    )
    running = Window.partitionBy("_ps_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"_ps_end": F.sum(size_col).over(running), "_ps_at": F.row_number().over(running)})
    placed = placed.join(F.broadcast(offsets), "_ps_part")
    placed = placed.select(
        *rows.drop("_ps_tie").columns,
        F.least(F.lit(shards - 1), F.expr(f"((2 * (_ps_from + _ps_end) - `{size_col}`) * {shards}L) div (2 * _ps_all)")).cast("int").alias("shard"),
        (F.col("_ps_row") + F.col("_ps_at") - 1).alias("_ps_row"),
    )
    first = placed.groupBy("shard").agg(F.min("_ps_row").alias("_ps_first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        *rows.drop("_ps_tie").columns, "shard", (F.col("_ps_row") - F.col("_ps_first")).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``."""
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col),
        (text_bytes(text) + F.lit(overhead)).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    out = assign_shards(narrow, shards, "size", [id_col, "text_crc32", "size"])
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
