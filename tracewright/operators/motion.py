"""Links by motion as a fold over frames: the flow and the positions before go from frame to frame.

A frame needs the links of the frame before, so frames follow each other; all movies
take the same step together, and within a step everything is a join, an aggregation
or the assignment over blocks. What is carried is two tables of one frame.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_probability, um_distance
from . import spatial
from .assign import optimal_one_to_one
from .shared import checkpointed

AXES = ("z", "y", "x")
SAMPLES = "dataset string, node_id long, t int, z double, y double, x double, sz double, sy double, sx double"


class Motion(NamedTuple):
    """Gates in micrometres, the flow's neighbours, and the weights of the cost."""

    seed: float = 3.0
    tight: float = 5.5
    relaxed: float = 8.0
    radius: float = 40.0
    neighbours: int = 12
    samples: int = 3
    exclude: float = 1e-6
    velocity: float = 0.5
    raw: float = 0.1
    bonus: float = 1.0
    raw_admits: bool = True


def _sampled(samples: DataFrame, gate: Motion) -> DataFrame:
    return samples.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= gate.samples).select("dataset")


def flow_at(points: DataFrame, samples: DataFrame, gate: Motion, exclude: float) -> DataFrame:
    """(dataset, node_id, fz, fy, fx): median step of the nearest ``samples``, those nearer than ``exclude`` left out.

    A movie with fewer than ``gate.samples`` samples has no flow.
    """
    samples = samples.join(_sampled(samples, gate), "dataset", "left_semi")
    near = spatial.knn_join(points, samples, gate.neighbours + 1, gate.radius, 0, other=False).where(F.col("d") >= exclude)
    order = Window.partitionBy("dataset", "a_node_id").orderBy("rank")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= gate.neighbours)
    step = samples.select("dataset", F.col("node_id").alias("b_node_id"), "sz", "sy", "sx")
    near = near.select("dataset", "a_node_id", "b_node_id").join(step, ["dataset", "b_node_id"])
    return near.groupBy("dataset", F.col("a_node_id").alias("node_id")).agg(*(F.percentile("s" + c, F.lit(0.5)).alias("f" + c) for c in AXES))


def _pairs(now: DataFrame, after: DataFrame, raw: DataFrame, samples: DataFrame, exclude: float, before: DataFrame, reach: float, gate: Motion) -> DataFrame:
    """(dataset, a, b, d, motion, prob, cost, near): pairs within ``reach`` of the point or of where it should be; ``near`` is the smallest gate that admits it."""
    moved = now.join(before, ["dataset", "node_id"], "left")
    moved = moved.join(flow_at(now, samples, gate, exclude), ["dataset", "node_id"], "left")
    step = lambda c: F.coalesce("f" + c, gate.velocity * (F.col(c) - F.col("o" + c)), F.lit(0.0))
    moved = checkpointed(moved.select("dataset", "node_id", "t", *AXES, *((F.col(c) + step(c)).alias("m" + c) for c in AXES), F.col("fz").isNotNull().alias("hit")), "moved")
    ahead = moved.select("dataset", "node_id", "t", *(F.col("m" + c).alias(c) for c in AXES))
    ids = ("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"))
    pairs = spatial.radius_join(now, after, reach, 1).select(*ids).union(spatial.radius_join(ahead, after, reach, 1).select(*ids)).distinct()
    pairs = pairs.join(moved.select("dataset", F.col("node_id").alias("a"), *(F.col(c).alias("p_" + c) for c in AXES), *(F.col("m" + c).alias("m_" + c) for c in AXES), "hit"), ["dataset", "a"])
    pairs = pairs.join(after.select("dataset", F.col("node_id").alias("b"), *(F.col(c).alias("q_" + c) for c in AXES)), ["dataset", "b"])
    pairs = pairs.withColumns({"d": um_distance("p_", "q_"), "motion": um_distance("m_", "q_")}).join(raw, ["dataset", "a", "b"], "left")
    pairs = pairs.join(_sampled(samples, gate).withColumn("field", F.lit(True)), "dataset", "left")
    own = F.when(F.col("field").isNull() | ~F.col("hit") | F.lit(gate.raw_admits), F.col("d"))
    near = F.least(own, F.when(F.col("field"), F.col("motion")))
    pairs = pairs.withColumns({"near": near, "prob": F.coalesce("prob", F.lit(0.0))}).where(F.col("near") <= reach)
    cost = F.col("motion") + gate.raw * F.col("d") - gate.bonus * F.col("prob")
    return checkpointed(pairs.select("dataset", "a", "b", "d", "motion", "prob", cost.alias("cost"), "near"), "pairs")


def _assigned(pairs: DataFrame, reach: float) -> DataFrame:
    pairs = pairs.where(F.col("near") <= reach)
    won = optimal_one_to_one(pairs.select("dataset", "a", "b", "cost"), "cost").select("dataset", "a", "b")
    return checkpointed(pairs.join(won, ["dataset", "a", "b"]), "assigned")


def _samples(links: DataFrame, now: DataFrame, after: DataFrame) -> DataFrame:
    got = links.select("dataset", F.col("a").alias("node_id"), "b").join(now, ["dataset", "node_id"])
    got = got.join(after.select("dataset", F.col("node_id").alias("b"), *(F.col(c).alias("q" + c) for c in AXES)), ["dataset", "b"])
    return got.select("dataset", "node_id", "t", *AXES, *((F.col("q" + c) - F.col(c)).alias("s" + c) for c in AXES))


def motion_fold(points: DataFrame, raw: DataFrame, gate: Motion = Motion()) -> DataFrame:
    """(dataset, a, b, t, stage, d, motion, prob, cost): each point's link to the next frame.

    In every frame a seed pass along the flow of the frame before gives this frame's
    flow, whose predictions are assigned within ``tight``, what is left within
    ``relaxed``. A point without a flow near moves on by ``velocity`` of its own last
    step, one without a link before stays. ``raw(dataset, source_id, target_id,
    edge_prob)`` lowers the cost of likely pairs; a value that is no probability is
    cleaned, a missing pair counts 0. A pass takes as many pairs as it can at the least
    cost. A movie without one of two frames keeps its flow. Points without a coordinate get no link; without points there are no rows.
    """
    spark = points.sparkSession
    points = checkpointed(points.select("dataset", "node_id", F.col("t").cast("int").alias("t"), *AXES).where("z + y + x IS NOT NULL"), "points")
    raw = checkpointed(raw.groupBy("dataset", F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.max(clean_probability(F.col("edge_prob"))).alias("prob")), "raw")
    flow = spark.createDataFrame([], SAMPLES)
    before = spark.createDataFrame([], "dataset string, node_id long, oz double, oy double, ox double")
    got = spark.createDataFrame([], "dataset string, a long, b long, t int, stage string, d double, motion double, prob double, cost double")
    frames = {r.t for r in points.select("t").distinct().collect()}  # one number for each frame
    for t in sorted(t for t in frames if t + 1 in frames):
        now, after = points.where(F.col("t") == t), points.where(F.col("t") == t + 1)
        seeds = _assigned(_pairs(now, after, raw, flow.withColumn("t", F.lit(t)), 0.0, before, gate.seed, gate), gate.seed)
        pairs = _pairs(now, after, raw, checkpointed(_samples(seeds, now, after), "field"), gate.exclude, before, gate.relaxed, gate)
        first = _assigned(pairs, gate.tight)
        rest = pairs.join(first.select("dataset", "a"), ["dataset", "a"], "left_anti").join(first.select("dataset", "b"), ["dataset", "b"], "left_anti")
        second = _assigned(rest, gate.relaxed)
        links = first.withColumn("stage", F.lit("tight")).unionByName(second.withColumn("stage", F.lit("relaxed")))
        got = got.unionByName(links.withColumn("t", F.lit(t)).drop("near"))
        both = now.select("dataset").distinct().join(after.select("dataset").distinct(), "dataset")
        flow = checkpointed(_samples(links, now, after).unionByName(flow.join(both, "dataset", "left_anti")), "flow")
        before = links.select("dataset", F.col("b").alias("node_id"), "a").join(now.select("dataset", F.col("node_id").alias("a"), *(F.col(c).alias("o" + c) for c in AXES)), ["dataset", "a"]).drop("a")
        before = checkpointed(before, "before")
    return got
