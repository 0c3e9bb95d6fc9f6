"""Tables, the point relations derived from them, and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import radius_join

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, node_id, t, z, y, x) from the embeddings: two movies of five frames."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    return e.select(
        F.concat(F.lit("d"), (F.col("label") % 2).cast("string")).alias("dataset"),
        F.col("vec_id").alias("node_id"),
        (F.col("vec_id") % 5).cast("int").alias("t"),
        (at(1) * 20).alias("z"),
        (at(2) * 80).alias("y"),
        (at(3) * 80).alias("x"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third point, moved a little along z."""
    return points(spark, sf_dir).where("node_id % 3 = 0").withColumn("z", F.col("z") + 0.01 * (F.col("node_id") % 7))


def candidate_edges(spark: SparkSession, sf_dir: str, radius: float = 4.0) -> DataFrame:
    """Links to the next frame within ``radius``, with a probability that falls with distance."""
    p = points(spark, sf_dir)
    e = radius_join(p, p, radius, 1)
    return e.select(
        "dataset",
        F.col("a_node_id").alias("source_id"),
        F.col("b_node_id").alias("target_id"),
        F.round(1 / (1 + F.col("d")), 6).alias("edge_prob"),
        F.round("d", 6).alias("distance_um"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored detections from the events: (user_id, d, event_id, score, value)."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"), "event_id", ((F.col("event_id") % 100) / 100.0).alias("score"), "value")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, d, v): mean value of each user and day, a track with gaps.

    Values are summed in order of event id, so that a mean does not depend on partitions: gates on
    differences of means have ties that the last bit decides.
    """
    some = detections(spark, sf_dir).select("user_id", "d", F.when(F.col("value").isNotNull(), F.struct("event_id", "value")).alias("e"))
    held = some.groupBy("user_id", "d").agg(F.sort_array(F.collect_list("e"))["value"].alias("vs"))
    total = F.aggregate("vs", F.lit(0.0), lambda s, v: s + v)
    return held.select("user_id", "d", F.when(F.size("vs") > 0, total / F.size("vs")).alias("v"))
