"""Session helpers shared by the operators: inputs, shared-folder tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``.

    Each round hooks every node to the neighbour of least hashed priority and
    contracts the edges, so the edge list shrinks geometrically whatever the
    shape of the graph. ``root`` is some node of the component. Nulls and self
    loops are ignored; an empty edge list gives an empty result.
    """
    kind = edges.schema["a"].dataType
    live = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    label = None
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select(F.col("a").alias("node"), F.col("b").alias("near")).union(live.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), c.alias("v"))
        hook = both.groupBy("node").agg(F.least(F.min(order(F.col("near"))), F.first(order(F.col("node"))))["v"].alias("up"))
        hook = materialize(hook, "hook")
        up_a, up_b = hook.toDF("a", "ua"), hook.toDF("b", "ub")
        live = live.join(up_a, "a").join(up_b, "b").where("ua <> ub")
        live = materialize(live.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        if label is None:
            label = hook.toDF("node", "root")
        else:
            step = hook.toDF("root", "up")
            label = label.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = materialize(label, "label")
    else:
        raise RuntimeError("components did not settle")
    if label is None:
        label = live.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    return label
