"""Lineage-graph operators on ``edges(dataset, source_id, target_id)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def degrees(edges: DataFrame) -> DataFrame:
    """(dataset, node_id, out_degree, in_degree) of all endpoints, in one aggregation."""
    ends = edges.select("dataset", F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select("dataset", F.col("target_id"), F.lit(0), F.lit(1))
    )
    return ends.groupBy("dataset", "node_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def single_successors(edges: DataFrame) -> DataFrame:
    """(dataset, node_id, next_id) of nodes with exactly one child."""
    one = edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("target_id").alias("next_id"))
    return one.where("n = 1").drop("n")


def single_predecessors(edges: DataFrame) -> DataFrame:
    one = edges.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("prev_id"))
    return one.where("n = 1").drop("n")


def best_per_side(edges: DataFrame, side: str, keep: int = 1) -> DataFrame:
    """The ``keep`` best edges of each target or source by probability, then distance, then ids."""
    order = Window.partitionBy("dataset", side).orderBy(F.col("edge_prob").desc_nulls_last(), "distance_um", "source_id", "target_id")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


#: Contracted edges that one task can finish.
FEW = 50_000


def _roots(frame: pd.DataFrame) -> pd.DataFrame:
    """(dataset, a, up): the root of each end of ``frame(dataset, a, b)``, by union and find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
        up[find(a)] = find(b)
    nodes = list(up)
    return pd.DataFrame({"dataset": [frame["dataset"].iloc[0]] * len(nodes), "a": nodes, "up": [find(x) for x in nodes]})


def components(edges: DataFrame, max_rounds: int = 64, few: int = FEW) -> DataFrame:
    """(dataset, node_id, component): the smallest node id of each weak component.

    A round hooks every node to the neighbour of least hashed priority and
    contracts the edges, which shrink geometrically for any shape of graph. The last
    ``few`` edges are contracted at once, in one task a dataset.
    """
    live = checkpointed(edges.where("source_id <> target_id").select("dataset", F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "edges")
    ends = edges.select("dataset", F.col("source_id").alias("node_id")).union(edges.select("dataset", "target_id")).distinct()
    label = checkpointed(ends.withColumn("root", F.col("node_id")), "labels")
    for turn in range(max_rounds):
        left = live.limit(few + 1).count()
        if 0 < left <= few:
            hook = live.groupBy("dataset").applyInPandas(_roots, "dataset string, a long, up long").toDF("dataset", "root", "up")
            label = checkpointed(label.join(hook, ["dataset", "root"], "left").select("dataset", "node_id", F.coalesce("up", "root").alias("root")), "labels")
        if left <= few:
            break
        both = live.union(live.select("dataset", "b", "a"))
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("p"), F.col(c).alias("v"))
        hook = both.groupBy("dataset", "a").agg(F.least(F.min(key("b")), F.min(key("a")))["v"].alias("up"))
        hook = checkpointed(hook, "hooks")
        moved = live.join(hook.toDF("dataset", "a", "ua"), ["dataset", "a"]).join(hook.toDF("dataset", "b", "ub"), ["dataset", "b"]).where("ua <> ub")
        live = checkpointed(moved.select("dataset", F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        step = hook.toDF("dataset", "root", "up")
        label = checkpointed(label.join(step, ["dataset", "root"], "left").select("dataset", "node_id", F.coalesce("up", "root").alias("root")), "labels")
    else:
        raise RuntimeError("components did not settle")
    least = label.groupBy("dataset", "root").agg(F.min("node_id").alias("component"))
    return label.join(least, ["dataset", "root"]).select("dataset", "node_id", "component")


def walk_lengths(nodes: DataFrame, step: DataFrame, cap: int) -> DataFrame:
    """(dataset, node_id, length): single links from each node along ``step(node_id, next_id)``, at most ``cap``.

    Pointer doubling: after i rounds a pointer spans 2**i links, so a cap of c needs log2(c) joins.
    """
    jump = step.toDF("dataset", "node_id", "to").withColumn("len", F.lit(1).cast("long"))
    done = 1
    while done < cap:
        ahead = jump.toDF("dataset", "to", "to2", "len2")
        jump = jump.join(ahead, ["dataset", "to"], "left").select("dataset", "node_id", F.col("to2").alias("to"), (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"))
        jump = checkpointed(jump, "jumps")
        done *= 2
    out = nodes.select("dataset", "node_id").join(jump, ["dataset", "node_id"], "left")
    return out.select("dataset", "node_id", F.least(F.coalesce("len", F.lit(0).cast("long")), F.lit(cap).cast("long")).alias("length"))
