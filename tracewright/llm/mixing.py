"""Operator 5: mixing sources to target weights by hash-threshold histograms.

Every row has a hash that its id, source and text decide, and among equal rows a
running number, so rows that lack an id or repeat one are taken one by one too. Sizes are summed by source and
leading hash bits; the bucket in which a source's budget ends is the only one
that is summed again by the next bits, and so on. The result is one hash
threshold for each source and copy, and a filter takes the rows below it: no
sort, and a hot source is only a thousand partial sums from each task.
Thresholds of the first and second copy are nested by construction.

Defined results: a null or wordless text has size 0 and takes 0; null is a source
of its own, after all others; an empty table gives no rows. Of rows equal in id,
source and text it is decided how many are taken; where other columns tell them
apart, the layout of the table decides which. Only the id, text and source columns
are read; columns whose names start with ``_mix_`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize

WEIGHTS = (3, 1, 2)
#: Hash bits of each level of the histograms.
LEVELS = (10, 10, 10)
#: Keys of repeated rows that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_KEYS = 500_000


def word_count(text) -> F.Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: one row for each source.

    The budget is filled by weight; sources that would pass ``most`` times their
    size stop there. With sources ordered by the level at which they stop, the
    common level follows from running sums.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("w"), (most * F.col("source_size")).alias("cap"))
    by_level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    past = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(past), F.lit(0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(past), F.lit(0))).alias("wl"),
    )
    open_ = F.col("left") * F.col("w") < F.col("cap") * F.col("wl")
    first = F.min(F.when(open_, F.struct(F.col("wl") * -1, "left", "wl"))).over(whole)
    return s.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), first["left"] * F.col("w") / first["wl"]), F.col("cap").cast("double")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For ``budgets(source, copy, budget)`` the hash below which ``rows(source, size, h)`` are taken.

    ``h`` has sum(LEVELS) bits. The threshold is the largest at which the sizes
    below it do not pass the budget; null sources equal each other.
    """
    bits = sum(LEVELS)
    open_ = budgets.select("source", "copy", F.col("budget").alias("room"), F.lit(0).cast("long").alias("low"))
    done = 0
    for level in LEVELS:
        shift = bits - done - level
        b = F.shiftright("h", shift)
        o = open_.select(F.col("source").alias("s"), F.col("copy").alias("c"), F.col("low").alias("l"))
        if done == 0:
            hist = rows.groupBy(F.col("source").alias("s"), b.alias("b")).agg(F.sum("size").alias("size"))
            same = open_["source"].eqNullSafe(hist["s"])
        else:
            inside = F.shiftright("h", bits - done) == F.shiftright("l", bits - done)
            here = rows.join(o, rows["source"].eqNullSafe(o["s"]) & inside)
            hist = here.groupBy("s", "c", b.alias("b")).agg(F.sum("size").alias("size"))
            same = open_["source"].eqNullSafe(hist["s"]) & (open_["copy"] == hist["c"])
        hist = open_.join(hist, same, "left").select("source", "copy", "room", "low", "b", "size")
        up = Window.partitionBy("source", "copy").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = hist.withColumn("run", F.coalesce(F.sum("size").over(up), F.lit(0)))
        fits = F.col("run") <= F.col("room")
        nexts = run.groupBy("source", "copy", "room", "low").agg(
            F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0)).alias("used"),
            F.min(F.when(~fits, F.col("b"))).alias("at"),
        )
        end = F.lit(1).cast("long") * (1 << bits)
        # a source that fits whole has no boundary: its threshold is past all hashes
        open_ = nexts.select("source", "copy", (F.col("room") - F.col("used")).alias("room"), F.coalesce(F.shiftleft("at", shift), F.when(F.col("low") == 0, end) if done == 0 else F.when(F.col("low") == end, end).otherwise(F.col("low"))).alias("low"))
        open_ = materialize(open_, "thresholds")  # one row for each source and copy
        done += level
    return open_.select("source", "copy", F.col("low").alias("below"))


def _key(id_col: str, text_col: str, source_col: str) -> F.Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = F.col(text_col)
    return F.md5(F.concat(part(F.col(id_col)), F.lit("|"), part(F.col(source_col)), F.lit("|"), part(text.isNull()), F.md5(part(text))))


def _hash() -> F.Column:
    told = F.md5(F.concat("_mix_key", F.lit(" "), F.col("_mix_nth").cast("string")))
    return F.shiftright(F.conv(F.substring(told, 1, 8), 16, 10).cast("long"), 32 - sum(LEVELS))


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows(_mix_key, ...)`` with ``_mix_nth``, from 0 among the rows of each of the keys ``repeated``.

    Rows are counted by task first, so a key on any share of the rows is spread
    over the tasks, and meets itself only as one count from each.
    """
    count = repeated.count()
    if count == 0:
        return rows.withColumn("_mix_nth", F.lit(0).cast("long"))
    repeated = F.broadcast(repeated) if count <= BROADCAST_KEYS else repeated
    once = rows.join(repeated, "_mix_key", "left_anti").withColumn("_mix_nth", F.lit(0).cast("long"))
    more = materialize(rows.withColumn("_mix_part", F.spark_partition_id()).join(repeated, "_mix_key", "left_semi"), "repeated")
    sizes = more.groupBy("_mix_key", "_mix_part").agg(F.count(F.lit(1)).alias("_mix_n"))
    before = Window.partitionBy("_mix_key").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_mix_key", "_mix_part", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_from"))
    here = Window.partitionBy("_mix_key", "_mix_part").orderBy("_mix_key")
    more = more.withColumn("_mix_at", F.row_number().over(here)).join(start, ["_mix_key", "_mix_part"])
    return once.unionByName(more.withColumn("_mix_nth", F.col("_mix_from") + F.col("_mix_at") - 1).select(*once.columns))


def _repeated(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("_mix_key").count().where("count > 1").select("_mix_key"), "keys")


def mixing_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """(source, b1, b2, source_size, target) of ``rows(source, size, h)``: one row for each source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share), "targets")
    once = targets.select("source", F.lit(1).alias("copy"), F.floor(F.least("target", F.col("source_size").cast("double"))).cast("long").alias("budget"))
    again = targets.select("source", F.lit(2), F.floor(F.greatest(F.col("target") - F.col("source_size"), F.lit(0.0))).cast("long"))
    found = thresholds(rows, once.union(again))
    # a document is taken twice only if it is taken once: the second threshold is at most the first
    below = found.groupBy(F.col("source").alias("s1")).agg(F.max(F.when(F.col("copy") == 1, F.col("below"))).alias("b1"), F.max(F.when(F.col("copy") == 2, F.col("below"))).alias("b2"))
    return targets.join(below, below["s1"].eqNullSafe(targets["source"])).select("source", "b1", "b2", "source_size", "target")


def _copies() -> F.Column:
    return (F.col("h") < F.col("b1")).cast("int") + (F.col("h") < F.col("b2")).cast("int")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, h) of every row, and the keys that several rows share."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _key(id_col, text_col, source_col).alias("_mix_key"))
    rows = materialize(rows, "sizes")
    repeated = _repeated(rows)
    told = _numbered(rows, repeated).select("id", "source", "size", _hash().alias("h"))
    return materialize(told, "hashes"), repeated


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source, source_size, target, copies, taken) of every row of ``docs``."""
    rows, _ = _sized(docs, id_col, text_col, source_col)
    plan = mixing_plan(rows, weights, share).withColumnRenamed("source", "s")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"]))  # one row for each source, so Spark broadcasts it while it is small
    out = out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", F.round("target", 3).alias("target"), _copies().alias("copies"))
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    rows, repeated = _sized(docs, id_col, text_col, source_col)
    plan = mixing_plan(rows, weights, share).select(F.col("source").alias("_mix_s"), F.col("b1").alias("_mix_1"), F.col("b2").alias("_mix_2"))
    plan = materialize(plan, "plan")
    names = [c for c in docs.columns if not c.startswith("_mix_")]
    told = _numbered(docs.select(*names, _key(id_col, text_col, source_col).alias("_mix_key")), repeated).withColumn("_mix_h", _hash())
    out = told.join(plan, told[source_col].eqNullSafe(plan["_mix_s"]))
    copies = (F.col("_mix_h") < F.col("_mix_1")).cast("int") + (F.col("_mix_h") < F.col("_mix_2")).cast("int")
    return out.select(*names, F.explode(F.array_repeat(F.lit(0), copies)).alias("_mix_again")).drop("_mix_again")
