"""Open ends of tracks grow into detections that were left out, guarded by motion, separation and a budget."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import um_distance
from .graph import degrees
from .shared import checkpointed
from .spatial import radius_join


class Guard(NamedTuple):
    """Gates in micrometres; ``share`` and ``most`` bound how many are added to a movie."""

    score: float = 0.94
    step: float = 3.0
    residual: float = 1.5
    separation: float = 1.5
    margin: float = 0.5
    share: float = 0.002
    most: int = 100


def independent_by_rank(items: DataFrame, claims: DataFrame, clashes: DataFrame) -> DataFrame:
    """The ``items(dataset, item, rank)`` that a loop by rank takes if it skips what conflicts with an earlier one.

    Two items conflict if they claim one key (``claims(dataset, item, kind, key)``) or are
    a row of ``clashes(dataset, a, b)``. Each round takes all that are first among the undecided at each of
    their keys and clashes, and drops what conflicts with them; the first of all is always taken, so it ends.
    Keys are hubs: those who share one are never paired.
    """
    live = checkpointed(items.select("dataset", "item", "rank"), "live")
    rank = lambda name: items.select("dataset", F.col("item").alias(name), F.col("rank").alias(name + "_rank"))
    clashes = clashes.select("dataset", "a", "b").union(clashes.select("dataset", "b", "a"))
    later = checkpointed(clashes.join(rank("a"), ["dataset", "a"]).join(rank("b"), ["dataset", "b"]).where("b_rank < a_rank").select("dataset", F.col("a").alias("item"), F.col("b").alias("before")).distinct(), "clashes")
    claims = checkpointed(claims.where("key is not null").join(items, ["dataset", "item"]).select("dataset", "item", "rank", "kind", "key").distinct(), "claims")
    key, one = ["dataset", "kind", "key"], ["dataset", "item"]
    taken = live.limit(0)
    while not live.isEmpty():
        open_claims = claims.join(live.select(*one), one, "left_semi")
        first = lambda rows: rows.groupBy(*key).agg(F.min("rank").alias("first"))
        behind = lambda firsts: open_claims.join(firsts, key).where("first < rank").select(*one)
        near = lambda of: later.join(of.select("dataset", F.col("item").alias("before")), ["dataset", "before"], "left_semi").select(*one)
        new = checkpointed(live.join(behind(first(open_claims)), one, "left_anti").join(near(live), one, "left_anti"), "taken")
        taken = taken.union(new)
        won = first(claims.join(new.select(*one), one, "left_semi"))
        live = live.join(new.select(*one), one, "left_anti").join(behind(won), one, "left_anti").join(near(new), one, "left_anti")
        live = checkpointed(live.select("dataset", "item", "rank"), "live")
    return taken


def _at(points: DataFrame, name: str, prefix: str) -> DataFrame:
    return points.select("dataset", F.col("node_id").alias(name), *(F.col(c).alias(prefix + c) for c in "tzyx"))


def _guess(rows: DataFrame, far: str, near: str) -> DataFrame:
    """``rows`` with where a track that went from ``far`` to ``near`` would be next, in columns ``g*``."""
    return rows.withColumns({"g" + c: 2 * F.col(near + c) - F.col(far + c) for c in "zyx"})


def _first_with_margin(rows: DataFrame, order: list, margin: float) -> DataFrame:
    """The cheapest row of each endpoint unless the next one is within ``margin``."""
    w = Window.partitionBy("dataset", "endpoint").orderBy("cost", *order)
    ranked = rows.withColumns({"k": F.row_number().over(w), "next": F.lead("cost").over(w)})
    return ranked.where((F.col("k") == 1) & (F.col("next").isNull() | (F.col("next") - F.col("cost") >= margin))).drop("k", "next")


def proposals(points: DataFrame, links: DataFrame, candidates: DataFrame, guard: Guard) -> DataFrame:
    """One row for each open end with a single good candidate: where it goes, at which cost, and what it would bridge to."""
    deg = degrees(links)
    one_in, one_out = deg.where("in_degree = 1 and out_degree = 0"), deg.where("in_degree = 0 and out_degree = 1")
    side = lambda rows, near, far, way: rows.select("dataset", "node_id").join(links.select("dataset", F.col(near).alias("node_id"), F.col(far).alias("context")), ["dataset", "node_id"]).withColumn("direction", F.lit(way))
    open_ = checkpointed(side(one_in, "target_id", "source_id", 1).union(side(one_out, "source_id", "target_id", -1)).withColumnRenamed("node_id", "endpoint"), "open")
    plain = deg.where("out_degree = 1 and in_degree <= 1").select("dataset", F.col("node_id").alias("context"))
    ends = open_.join(plain, ["dataset", "context"], "left_semi").join(_at(points, "endpoint", "e"), ["dataset", "endpoint"]).join(_at(points, "context", "c"), ["dataset", "context"])
    ends = ends.where((F.col("ct") == F.col("et") - F.col("direction")) & (um_distance("e", "c") <= guard.step))
    ends = checkpointed(_guess(ends, "c", "e").drop("context", "ct", "cz", "cy", "cx"), "ends")

    # candidates that no node of their frame is too close to
    fit = candidates.where(F.col("score") >= guard.score)
    crowded = radius_join(fit, points, guard.separation).where(F.col("d") < guard.separation).select("dataset", F.col("a_node_id").alias("node_id"))
    fit = checkpointed(fit.join(crowded, ["dataset", "node_id"], "left_anti"), "candidates")

    def met(rows: DataFrame, prefix: str, others: DataFrame, way: int) -> DataFrame:
        """(dataset, endpoint, other, d): points at ``prefix`` of ``rows`` with ``others`` one frame on."""
        here = rows.where(F.col("direction") == way).select("dataset", F.col("endpoint").alias("node_id"), *(F.col(prefix + c).alias(c) for c in "tzyx"))
        return radius_join(here, others, guard.step, way).select("dataset", F.col("a_node_id").alias("endpoint"), F.col("b_node_id").alias("other"), *(F.col("b_" + c).alias("o" + c) for c in "tzyx"), "d")

    near = met(ends, "e", fit, 1).union(met(ends, "e", fit, -1)).join(ends, ["dataset", "endpoint"])
    near = near.withColumn("residual", um_distance("g", "o")).where(F.col("residual") <= guard.residual)
    near = near.join(fit.select("dataset", F.col("node_id").alias("other"), "score"), ["dataset", "other"]).withColumn("cost", F.col("residual") + 0.25 * F.col("d"))
    best = _first_with_margin(near, [F.desc("score"), "other"], guard.margin)
    best = checkpointed(best.select("dataset", "endpoint", "direction", F.col("other").alias("candidate"), "cost", *(F.col("e" + c) for c in "zyx"), *(F.col("o" + c).alias("p" + c) for c in "tzyx")), "best")

    # open ends of the other kind, one frame further, that the grown track would reach
    opposite = lambda way: points.join(open_.where(F.col("direction") == -way).select("dataset", F.col("endpoint").alias("node_id")), ["dataset", "node_id"], "left_semi")
    reach = met(best, "p", opposite(1), 1).union(met(best, "p", opposite(-1), -1)).join(_guess(best, "e", "p").select("dataset", "endpoint", "gz", "gy", "gx"), ["dataset", "endpoint"])
    reach = reach.withColumn("error", um_distance("g", "o")).where(F.col("error") <= guard.residual).withColumn("cost", F.col("error") + 0.25 * F.col("d"))
    bridge = _first_with_margin(reach, ["other"], guard.margin).select("dataset", "endpoint", "other")
    return best.drop("ez", "ey", "ex").join(bridge, ["dataset", "endpoint"], "left")


def readmit(points: DataFrame, links: DataFrame, candidates: DataFrame, guard: Guard = Guard()) -> DataFrame:
    """(dataset, place, endpoint, direction, candidate, other, cost): what a loop by (bridges first, cost, ids) adds.

    ``candidates(dataset, node_id, t, z, y, x, score)`` have ids of their own. An end of a
    track takes the one candidate near where it would move, if no node is within the
    separation and the next best is worse by the margin. No candidate or end is used twice, no
    two added points are within the separation, and a movie gets ``share`` of its points at most, and not more than ``most``.
    """
    told = checkpointed(proposals(points, links, candidates, guard), "proposals")
    rank = F.struct(F.col("other").isNull().alias("single"), "cost", "endpoint", "direction", "candidate", "other").alias("rank")
    items = told.select("dataset", F.col("endpoint").alias("item"), rank)
    claim = lambda kind, key: told.select("dataset", F.col("endpoint").alias("item"), F.lit(kind).alias("kind"), F.col(key).alias("key"))
    spots = told.select("dataset", F.col("endpoint").alias("node_id"), *(F.col("p" + c).alias(c) for c in "tzyx"))
    close = radius_join(spots, spots, guard.separation).where((F.col("d") < guard.separation) & (F.col("a_node_id") != F.col("b_node_id")))
    taken = independent_by_rank(items, claim("end", "endpoint").union(claim("end", "other")).union(claim("candidate", "candidate")), close.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b")))
    budget = points.groupBy("dataset").agg(F.least(F.lit(guard.most), F.floor(F.count(F.lit(1)) * guard.share)).alias("budget"))
    # what is accepted does not depend on what comes later, so the budget cuts the list
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("rank"))
    kept = taken.withColumn("place", place).join(budget, "dataset").where("place <= budget").select("dataset", F.col("item").alias("endpoint"), "place")
    return kept.join(told, ["dataset", "endpoint"]).select("dataset", "place", "endpoint", "direction", "candidate", "other", "cost")
