"""Registration of queries and the common table expressions of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import TABLES, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DIST = "sqrt(({a}.z-{b}.z)*1.625*(({a}.z-{b}.z)*1.625)+({a}.y-{b}.y)*0.40625*(({a}.y-{b}.y)*0.40625)+({a}.x-{b}.x)*0.40625*(({a}.x-{b}.x)*0.40625))"
PTS = """pts AS (SELECT 'd' || (label % 2)::VARCHAR AS dataset, vec_id AS node_id, (vec_id % 5)::INTEGER AS t,
    embedding[1]::DOUBLE * 20 AS z, embedding[2]::DOUBLE * 80 AS y, embedding[3]::DOUBLE * 80 AS x FROM embeddings)"""
GT = PTS + ", gt AS (SELECT dataset, node_id, t, z + 0.01 * (node_id % 7) AS z, y, x FROM pts WHERE node_id % 3 = 0)"


def pairs_sql(radius: float, dt: int, left: str = "pts", right: str = "pts", name: str = "near") -> str:
    d = DIST.format(a="a", b="b")
    return f"{name} AS (SELECT a.dataset, a.node_id AS a, b.node_id AS b, {d} AS d FROM {left} a JOIN {right} b ON a.dataset = b.dataset AND b.t = a.t + {dt} WHERE {d} <= {radius})"


CAND = PTS + ", " + pairs_sql(4.0, 1) + ", cand AS (SELECT dataset, a AS source_id, b AS target_id, round(1 / (1 + d), 6) AS edge_prob, round(d, 6) AS distance_um FROM near)"
DET = "det AS (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS d, event_id, (event_id % 100) / 100.0::DOUBLE AS score, value FROM events)"
TRACKS = DET + ", tracks AS (SELECT user_id, d, avg(value) AS v FROM det GROUP BY user_id, d)"


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` is SQL with the same columns."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return register


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in Spark SQL over the tables; ``oracle`` defaults to the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if f"{{{t}}}" in text]
        braced = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            braced = braced.replace(f"{{{{{t}}}}}", f"{{{t}}}")
        return spark.sql(braced, **{t: table(spark, sf_dir, t) for t in used})

    plain = text
    for t in TABLES:
        plain = plain.replace(f"{{{t}}}", t)
    query(name, plain if oracle is None else oracle)(run)
