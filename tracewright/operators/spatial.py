"""Range, nearest-neighbour, semi and anti joins of points by distance.

Points carry ``dataset, node_id, t, z, y, x``. A range join deals both sides to
grid cells of the radius in micrometres and compares a point with the 27 cells
around it, so it is an equi-join whose cost follows the pairs. Nearest neighbours
need no pairs: points are cut into leaves along a space-filling curve, the boxes
of the leaves bound how far the nearest can be, and a task compares a tile of left
points with the leaves inside that bound, nearest leaf first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import um_distance
from ..schema import SCALE
from .shared import checkpointed

#: Points of a leaf, leaves of a tile, left points that are compared at once.
LEAF, TILE, BLOCK = 512, 8, 128
NEAREST = "dataset string, a_node_id long, b_node_id long, d double"


def _side(points: DataFrame, prefix: str) -> DataFrame:
    return points.select("dataset", *(F.col(c).alias(prefix + c) for c in ("node_id", "t", "z", "y", "x")))


def radius_join(left: DataFrame, right: DataFrame, radius: float, dt: int = 0) -> DataFrame:
    """All (a, b) with b in frame ``t + dt`` of the same dataset within ``radius``: a*, b*, ``d``.

    Points without a coordinate match nothing; a point matches itself when both
    sides hold it.
    """
    a, b = _side(left, "a_"), _side(right, "b_")
    for axis, step in zip("zyx", SCALE, strict=True):
        cell = F.floor(F.col(f"a_{axis}") * step / radius)
        a = a.withColumn(f"c{axis}", F.explode(F.array(cell - 1, cell, cell + 1)))
        b = b.withColumn(f"c{axis}", F.floor(F.col(f"b_{axis}") * step / radius))
    a = a.withColumn("frame", F.col("a_t") + dt)
    b = b.withColumn("frame", F.col("b_t"))
    pairs = a.join(b, ["dataset", "frame", "cz", "cy", "cx"]).withColumn("d", um_distance("a_", "b_"))
    return pairs.where(F.col("d") <= radius).drop("frame", "cz", "cy", "cx")


def _along_curve() -> Column:
    """Position on a Z-order curve of steps of 1/64 um, 21 bits an axis."""
    code = F.lit(0).cast("long")
    for i, (axis, step) in enumerate(zip("zyx", SCALE, strict=True)):
        x = F.least(F.greatest(F.floor(F.col(axis) * step * 64) + 2**20, F.lit(0)), F.lit(2**21 - 1)).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        code = code.bitwiseOR(F.shiftleft(x, i))
    return code


def leaves(points: DataFrame, *more: str, size: int = LEAF) -> DataFrame:
    """(dataset, node_id, t, z, y, x, *more, curve, leaf) of points with finite coordinates, ``size`` to a leaf, about; neighbours share leaves.

    Ranges are cut by sampled quantiles of movie, frame, curve and id, so that equal points are cut too.
    """
    finite = F.abs(F.col("z") + F.col("y") + F.col("x")) < float("inf")
    p = points.select("dataset", "node_id", F.col("t").cast("int").alias("t"), *(F.col(c).cast("double").alias(c) for c in "zyx"), *more, _along_curve().alias("curve")).where(finite)
    parts = max(1, -(-p.count() // size))
    p = p.repartitionByRange(parts, "dataset", "t", "curve", F.xxhash64("node_id")).withColumn("leaf", F.spark_partition_id())
    return checkpointed(p.coalesce(max(1, min(parts, p.sparkSession.sparkContext.defaultParallelism * 4))), "leaves")


def _boxes(parts: DataFrame, name: str, prefix: str) -> DataFrame:
    um = [(axis, F.col(axis) * step) for axis, step in zip("zyx", SCALE, strict=True)]
    ends = [f(c).alias(prefix + e + axis) for axis, c in um for e, f in (("lo", F.min), ("hi", F.max))]
    return parts.groupBy("dataset", "t", name).agg(F.count(F.lit(1)).alias(prefix + "n"), *ends)


def tile_pairs(left: DataFrame, right: DataFrame, radius: float, dt: int = 0, wanted: int | None = None, inner: float = 0.0) -> DataFrame:
    """(dataset, t, tile, leaf): leaves of ``right`` in frame ``t + dt`` that may hold what a tile of ``left`` looks for.

    That is all within ``radius``, or the ``wanted`` nearest of those at ``inner`` or further.
    ``left`` has a column ``tile``. Only boxes are joined, a few for each thousand points.
    """
    a, b = _boxes(left, "tile", "a_"), _boxes(right, "leaf", "b_").withColumn("t", F.col("t") - dt)
    over = lambda f: F.sqrt(sum((f(axis) * f(axis) for axis in "yx"), f("z") * f("z")))
    gap = over(lambda c: F.greatest(F.lit(0.0), F.col("a_lo" + c) - F.col("b_hi" + c), F.col("b_lo" + c) - F.col("a_hi" + c)))
    span = over(lambda c: F.greatest(F.col("a_hi" + c) - F.col("b_lo" + c), F.col("b_hi" + c) - F.col("a_lo" + c)))
    both = a.join(b, ["dataset", "t"]).select("dataset", "t", "tile", "leaf", "b_n", gap.alias("gap"), span.alias("span"))
    slack = 1e-9 + radius * 1e-9
    both = both.where(F.col("gap") <= radius + slack)
    if wanted is None:
        return both.select("dataset", "t", "tile", "leaf")
    sure = F.sum(F.when(F.col("gap") >= inner + slack, F.col("b_n")).otherwise(0) if inner else F.col("b_n")).over(Window.partitionBy("dataset", "t", "tile").orderBy("span", "leaf"))
    reach = F.min(F.when(F.col("sure") >= wanted, F.col("span"))).over(Window.partitionBy("dataset", "t", "tile"))
    both = both.withColumn("sure", sure).withColumn("reach", reach)
    return both.where(F.col("reach").isNull() | (F.col("gap") <= F.col("reach") + slack)).select("dataset", "t", "tile", "leaf")


def over_tiles(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, radius: float, dt: int = 0, wanted: int | None = None, inner: float = 0.0) -> DataFrame:
    """``kernel(left, right)`` for each tile of leaves of ``left`` with the leaves of ``right`` that ``tile_pairs`` names."""
    left = left.withColumn("tile", F.floor(F.col("leaf") / TILE))
    pairs = tile_pairs(left, right, radius, dt, wanted, inner)
    near = right.withColumn("t", F.col("t") - dt).join(pairs, ["dataset", "t", "leaf"])
    near = near.toDF(*near.columns)  # names of its own, where both sides are one table
    spark, key = left.sparkSession, ("dataset", "t", "tile")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # small in bytes, not in work
    return left.repartition(tasks, *key).groupBy(*key).cogroup(near.repartition(tasks, *key).groupBy(*key)).applyInPandas(kernel, schema)


def in_um(frame: pd.DataFrame) -> list[np.ndarray]:
    return [frame[axis].to_numpy() * step for axis, step in zip("zyx", SCALE, strict=True)]


def distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Micrometres between all of ``a`` and all of ``b`` (z, y, x each), with the arithmetic of ``um_distance``."""
    total = None
    for p, q, step in zip(a, b, SCALE, strict=True):
        d = (p[:, None] - q[None, :]) * step
        d *= d
        total = d if total is None else total + d
    return np.sqrt(total)


def distances_of_rows(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Micrometres between the rows of ``a`` and those of ``b``, one by one."""
    z, y, x = ((p - q) * step for p, q, step in zip(a, b, SCALE, strict=True))
    return np.sqrt(z * z + y * y + x * x)


def blocks_by_leaf(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[tuple[float, slice]], pd.DataFrame]]:
    """Blocks of ``left`` with the slices of ``right`` (sorted by leaf, then id), one a leaf, nearest first, and how far each leaf is at least."""
    left, right = left.sort_values("curve", kind="stable"), right.sort_values(["leaf", "node_id"], kind="stable", ignore_index=True)
    leaf = right["leaf"].to_numpy()
    cut = np.r_[0, np.flatnonzero(np.diff(leaf)) + 1]
    box = [(np.minimum.reduceat(c, cut), np.maximum.reduceat(c, cut)) for c in in_um(right)]
    ends = np.r_[cut[1:], len(leaf)]
    for i in range(0, len(left), BLOCK):
        block = left.iloc[i : i + BLOCK]
        gap = np.sqrt(sum(np.maximum(0, np.maximum(c.min() - hi, lo - c.max())) ** 2 for c, (lo, hi) in zip(in_um(block), box, strict=True)))
        yield block, [(gap[j], slice(cut[j], ends[j])) for j in np.argsort(gap, kind="stable")], right


def nearest_kernel(left: pd.DataFrame, right: pd.DataFrame, k: int, radius: float, inner: float, other: bool) -> pd.DataFrame:
    """The ``k`` nearest of ``right`` at ``inner`` to ``radius`` of each row of ``left``, as NEAREST; ties go to the smaller id."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for block, slices, right_ in blocks_by_leaf(left, right) if len(left) and len(right) else ():
        ids, at = block["node_id"].to_numpy(), [block[c].to_numpy() for c in "zyx"]
        b_ids, b_at = right_["node_id"].to_numpy(), [right_[c].to_numpy() for c in "zyx"]
        most = np.full(len(ids), radius)
        row, got, d = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        for gap, part in slices:
            if gap > most.max() + 1e-9 * (1 + radius):
                break
            far = distances(at, [c[part] for c in b_at])
            fit = far <= most[:, None]
            if inner > 0:
                fit &= far >= inner
            if other:
                fit &= ids[:, None] != b_ids[None, part]
            if fit.sum() > 2 * k * len(ids) and k < far.shape[1]:
                fit &= far <= np.partition(np.where(fit, far, np.inf), k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(fit)
            if not len(r):
                continue
            row, got, d = np.r_[row, r], np.r_[got, b_ids[part][c]], np.r_[d, far[r, c]]
            order = np.lexsort((got, d, row))
            row, got, d = row[order], got[order], d[order]
            start = np.searchsorted(row, np.arange(len(ids)))
            keep = np.arange(len(row)) - start[row] < k
            row, got, d = row[keep], got[keep], d[keep]
            ends = np.searchsorted(row, np.arange(len(ids)), side="right")
            full = ends - np.searchsorted(row, np.arange(len(ids))) == k
            most[full] = d[ends[full] - 1]
        out.append((ids[row], got, d))
    a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
    name = left["dataset"].iloc[0] if len(left) else None
    return pd.DataFrame({"dataset": np.full(len(a), name, object), "a_node_id": a, "b_node_id": b, "d": d})


def nearest_of_leaves(left: DataFrame, right: DataFrame, k: int, radius: float, dt: int = 0, other: bool = True, inner: float = 0.0) -> DataFrame:
    """NEAREST of two tables of ``leaves``."""

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest_kernel(a, b, k, radius, inner, other)

    return over_tiles(left, right, kernel, NEAREST, radius, dt, k + other, inner)


def _leaves_of(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = leaves(left)
    return cut, cut if left is right else leaves(right)


def knn_join(left: DataFrame, right: DataFrame, k: int, radius: float, dt: int = 0, other: bool = True, inner: float = 0.0) -> DataFrame:
    """The ``k`` nearest at ``inner`` to ``radius`` of each left point: a_node_id, b_node_id, ``d``, ``rank``; ties go to the smaller id.

    ``other``: a point is not its own neighbour.
    """
    pairs = nearest_of_leaves(*_leaves_of(left, right), k, radius, dt, other, inner)
    order = Window.partitionBy("dataset", "a_node_id").orderBy("d", "b_node_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _nearest(left: DataFrame, right: DataFrame, radius: float, dt: int, other: bool) -> DataFrame:
    best = nearest_of_leaves(left, right, 1, radius, dt, other).groupBy("dataset", "a_node_id").agg(F.min(F.struct("d", "b_node_id")).alias("m"))
    return best.select("dataset", "a_node_id", F.col("m.b_node_id").alias("b_node_id"), F.col("m.d").alias("d"))


def nearest_join(left: DataFrame, right: DataFrame, radius: float, dt: int = 0, other: bool = True) -> DataFrame:
    """Each left point with its nearest right point within ``radius``."""
    return _nearest(*_leaves_of(left, right), radius, dt, other)


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, dt: int = 0) -> DataFrame:
    """Pairs that are each other's nearest within ``radius``."""
    a, b = _leaves_of(left, right)
    back = _nearest(b, a, radius, -dt, True).select("dataset", F.col("b_node_id").alias("a_node_id"), F.col("a_node_id").alias("b_node_id"))
    return _nearest(a, b, radius, dt, True).join(back, ["dataset", "a_node_id", "b_node_id"])


def near(points: DataFrame, others: DataFrame, radius: float, dt: int = 0) -> DataFrame:
    """(dataset, node_id) of points with another point of ``others`` within ``radius`` in frame t + dt."""
    return nearest_join(points, others, radius, dt).select("dataset", F.col("a_node_id").alias("node_id"))


def distance_semi(points: DataFrame, others: DataFrame, radius: float, dt: int = 0) -> DataFrame:
    return points.join(near(points, others, radius, dt), ["dataset", "node_id"], "left_semi")


def distance_anti(points: DataFrame, others: DataFrame, radius: float, dt: int = 0) -> DataFrame:
    return points.join(near(points, others, radius, dt), ["dataset", "node_id"], "left_anti")
