"""Joins by key and by distance, and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import um_distance
from ..operators import assign, spatial
from ..sources import candidate_edges, ground_truth, points, table, tracks
from .base import CAND, DIST, GT, PTS, TRACKS, pairs_sql, query, sql_query

sql_query(
    "JN01_endpoint_lookup",
    """SELECT n.n_name AS nation, c.c_mktsegment AS segment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
    FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
    GROUP BY n.n_name, c.c_mktsegment""",
)
sql_query(
    "JN02_dangling_edges",
    """SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l LEFT ANTI JOIN (SELECT * FROM {orders} WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey""",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
)
sql_query(
    "JN03_key_intersection",
    """SELECT a.o_custkey AS custkey, a.n AS n_open, b.n AS n_filled
    FROM (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey) a
    JOIN (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.o_custkey = b.o_custkey""",
)
sql_query(
    "JN04_left_join_flags",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, l.doc_id IS NOT NULL AS labelled
    FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
)


@query("JN05_radius_join", f"WITH {PTS}, {pairs_sql(4.0, 0)} SELECT dataset, a, b, round(d, 6) AS d FROM near WHERE a < b")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    pairs = spatial.radius_join(p, p, 4.0).where("a_node_id < b_node_id")
    return pairs.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), F.round("d", 6).alias("d"))


@query(
    "JN06_frame_pair_or_join",
    f"""WITH {PTS}, moved AS (SELECT dataset, node_id, t, z + 0.5 AS z, y, x FROM pts), {pairs_sql(3.0, 1)}, {pairs_sql(3.0, 1, 'moved', 'pts', 'near2')}
    SELECT DISTINCT dataset, a, b FROM (SELECT dataset, a, b FROM near UNION ALL SELECT dataset, a, b FROM near2)""",
)
def frame_pair_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moved = p.withColumn("z", F.col("z") + 0.5)
    both = spatial.radius_join(p, p, 3.0, 1).select("dataset", "a_node_id", "b_node_id").union(spatial.radius_join(moved, p, 3.0, 1).select("dataset", "a_node_id", "b_node_id"))
    return both.distinct().toDF("dataset", "a", "b")


@query(
    "JN07_gap_interval_join",
    f"""WITH {TRACKS}, e AS (SELECT user_id, d, v FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM tracks n WHERE n.user_id = t.user_id AND n.d = t.d + 1)),
    s AS (SELECT user_id, d, v FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM tracks n WHERE n.user_id = t.user_id AND n.d = t.d - 1))
    SELECT e.user_id, e.d AS end_d, g.g::INTEGER AS gap, s.d AS start_d, round(abs(s.v - e.v), 6) AS step
    FROM e, range(1, 4) g(g), s WHERE s.user_id = e.user_id AND s.d = e.d + g.g + 1 AND abs(s.v - e.v) <= 20 * (g.g + 1)""",
)
def gap_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track ends joined with starts after one to three missing days, inside a gate that widens with the gap."""
    t = tracks(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("d")
    t = t.withColumns({"next": F.lead("d").over(w), "prev": F.lag("d").over(w)})
    ends = t.where("next is null or next > d + 1").select("user_id", F.col("d").alias("end_d"), F.col("v").alias("ev"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("gap"))
    starts = t.where("prev is null or prev < d - 1").select("user_id", F.col("d").alias("start_d"), F.col("v").alias("sv"))
    ends = ends.withColumn("start_d", F.col("end_d") + F.col("gap") + 1)
    pairs = ends.join(starts, ["user_id", "start_d"]).withColumn("gate", F.abs(F.col("sv") - F.col("ev")))
    return pairs.where(F.col("gate") <= 20 * (F.col("gap") + 1)).select("user_id", "end_d", "gap", "start_d", F.round("gate", 6).alias("step"))


@query(
    "JN08_knn_join",
    f"""WITH {PTS}, {pairs_sql(12.0, 0)}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, a ORDER BY d, b) AS rank FROM near WHERE a <> b)
    SELECT dataset, a, b, rank, round(d, 6) AS d FROM r WHERE rank <= 4""",
)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    k = spatial.knn_join(p, p, 4, 12.0)
    return k.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "rank", F.round("d", 6).alias("d"))


@query(
    "JN09_nearest_with_value",
    f"""WITH {GT}, {pairs_sql(6.0, 0, 'pts', 'gt')}, m AS (SELECT dataset, a, min({{'d': d, 'b': b}}) AS m FROM near WHERE a <> b GROUP BY dataset, a)
    SELECT p.dataset, p.node_id, coalesce(m.m.b, -1) AS near_id, coalesce(round(m.m.d, 6), -1) AS d FROM pts p LEFT JOIN m ON m.dataset = p.dataset AND m.a = p.node_id""",
)
def nearest_with_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = spatial.nearest_join(p, ground_truth(spark, sf_dir), 6.0).withColumnRenamed("a_node_id", "node_id")
    out = p.select("dataset", "node_id").join(near, ["dataset", "node_id"], "left")
    return out.select("dataset", "node_id", F.coalesce("b_node_id", F.lit(-1).cast("long")).alias("near_id"), F.coalesce(F.round("d", 6), F.lit(-1.0)).alias("d"))


@query(
    "JN10_mutual_nearest",
    f"""WITH {PTS}, {pairs_sql(6.0, 1)}, f AS (SELECT dataset, a, arg_min(b, {{'d': d, 'b': b}}) AS b FROM near GROUP BY dataset, a),
    g AS (SELECT dataset, b, arg_min(a, {{'d': d, 'a': a}}) AS a FROM near GROUP BY dataset, b) SELECT f.dataset, f.a, f.b FROM f JOIN g USING (dataset, a, b)""",
)
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return spatial.mutual_nearest(p, p, 6.0, 1).select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"))


@query(
    "JN11_nearest_of_child",
    f"""WITH {CAND}, c AS (SELECT dataset, target_id, count(*) AS n FROM cand GROUP BY dataset, target_id), {pairs_sql(8.0, 0, name='same')},
    m AS (SELECT dataset, a, arg_min(b, {{'d': d, 'b': b}}) AS b FROM same WHERE a <> b GROUP BY dataset, a)
    SELECT m.dataset, m.a AS node_id, m.b AS child_id FROM m JOIN c ON c.dataset = m.dataset AND c.target_id = m.b""",
)
def nearest_of_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose nearest neighbour in the frame is the child of some link."""
    p = points(spark, sf_dir)
    near = spatial.nearest_join(p, p, 8.0).select("dataset", F.col("a_node_id").alias("node_id"), F.col("b_node_id").alias("child_id"))
    children = candidate_edges(spark, sf_dir).select("dataset", F.col("target_id").alias("child_id")).distinct()
    return near.join(children, ["dataset", "child_id"], "left_semi").select("dataset", "node_id", "child_id")


@query("JN12_distance_anti_join", f"WITH {GT}, {pairs_sql(5.0, 0, 'pts', 'gt')} SELECT dataset, node_id, t FROM pts p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.dataset = p.dataset AND n.a = p.node_id AND n.a <> n.b)")
def distance_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.distance_anti(points(spark, sf_dir), ground_truth(spark, sf_dir), 5.0).select("dataset", "node_id", "t")


@query("JN13_distance_semi_join", f"WITH {GT}, {pairs_sql(5.0, 1, 'pts', 'gt')} SELECT dataset, node_id, t FROM pts p WHERE EXISTS (SELECT 1 FROM near n WHERE n.dataset = p.dataset AND n.a = p.node_id)")
def distance_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.distance_semi(points(spark, sf_dir), ground_truth(spark, sf_dir), 5.0, 1).select("dataset", "node_id", "t")


@query(
    "JN14_temporal_support",
    f"WITH {PTS}, {pairs_sql(4.0, 1)}, {pairs_sql(4.0, -1, name='back')} SELECT dataset, a AS node_id FROM near INTERSECT SELECT dataset, a FROM back",
)
def temporal_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return spatial.near(p, p, 4.0, 1).intersect(spatial.near(p, p, 4.0, -1))


@query(
    "JN15_anchored_theta_join",
    f"""WITH {PTS}, {pairs_sql(3.0, 1)}, j AS (SELECT n1.dataset, n1.a, n1.b AS mid, n2.b FROM near n1 JOIN near n2 ON n1.dataset = n2.dataset AND n1.b = n2.a)
    SELECT j.dataset, j.a AS tail, j.mid AS peak, j.b AS head FROM j JOIN pts p ON p.dataset = j.dataset AND p.node_id = j.a JOIN pts m ON m.dataset = j.dataset AND m.node_id = j.mid
    JOIN pts q ON q.dataset = j.dataset AND q.node_id = j.b
    WHERE sqrt(((p.z+q.z)/2-m.z)*1.625*(((p.z+q.z)/2-m.z)*1.625)+((p.y+q.y)/2-m.y)*0.40625*(((p.y+q.y)/2-m.y)*0.40625)+((p.x+q.x)/2-m.x)*0.40625*(((p.x+q.x)/2-m.x)*0.40625)) <= 1.5""",
)
def anchored_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks between a tail and a head, within the gate of both and near their midpoint."""
    p = points(spark, sf_dir)
    near = spatial.radius_join(p, p, 3.0, 1)
    first = near.select("dataset", F.col("a_node_id").alias("tail"), *(F.col(f"a_{c}").alias(f"p{c}") for c in "zyx"), F.col("b_node_id").alias("peak"), *(F.col(f"b_{c}").alias(f"m{c}") for c in "zyx"))
    second = near.select("dataset", F.col("a_node_id").alias("peak"), F.col("b_node_id").alias("head"), *(F.col(f"b_{c}").alias(f"q{c}") for c in "zyx"))
    both = first.join(second, ["dataset", "peak"])
    both = both.withColumns({f"h{c}": (F.col(f"p{c}") + F.col(f"q{c}")) / 2 for c in "zyx"})
    return both.where(um_distance("h", "m") <= 1.5).select("dataset", "tail", "peak", "head")


def _assigned(spark: SparkSession, sf_dir: str, radius: float, p: DataFrame | None = None) -> DataFrame:
    """(dataset, a, b, cost): points assigned to the truth of their frame within ``radius``."""
    got = assign.optimal_nearest(ground_truth(spark, sf_dir), points(spark, sf_dir) if p is None else p, radius, 0)
    return got.select("dataset", F.col("b").alias("a"), F.col("a").alias("b"), "cost")


#: Every assignment of every connected component of ``near(dataset, a, b, d)``, row by row; the one with most pairs, then least cost, stays.
ASSIGNED = """sides AS (SELECT dataset, a, a AS r FROM near UNION SELECT s.dataset, n.a, s.r FROM sides s JOIN near m ON m.dataset = s.dataset AND m.a = s.a JOIN near n ON n.dataset = m.dataset AND n.b = m.b),
    part AS (SELECT dataset, a, min(r) AS c FROM sides GROUP BY dataset, a), turn AS (SELECT *, row_number() OVER (PARTITION BY dataset, c ORDER BY a) AS i FROM part),
    choice AS (SELECT t.dataset, t.c, t.i, t.a, n.b, n.d FROM turn t JOIN near n ON n.dataset = t.dataset AND n.a = t.a UNION ALL SELECT dataset, c, i, a, NULL, 0 FROM turn),
    tried AS (SELECT dataset, c, 0::BIGINT AS i, []::STRUCT(a BIGINT, b BIGINT, d DOUBLE)[] AS got, []::BIGINT[] AS used, 0::DOUBLE AS total FROM (SELECT DISTINCT dataset, c FROM part)
        UNION ALL SELECT k.dataset, k.c, k.i, CASE WHEN k.b IS NULL THEN got ELSE list_append(got, {'a': k.a, 'b': k.b, 'd': k.d}) END, CASE WHEN k.b IS NULL THEN used ELSE list_append(used, k.b) END, total + k.d
        FROM tried JOIN choice k ON k.dataset = tried.dataset AND k.c = tried.c AND k.i = tried.i + 1 WHERE k.b IS NULL OR NOT list_contains(used, k.b)),
    best AS (SELECT t.dataset, t.c, arg_min(got, [-len(got)::DOUBLE, total]) AS got FROM tried t JOIN (SELECT dataset, c, max(i) AS n FROM turn GROUP BY dataset, c) m ON m.dataset = t.dataset AND m.c = t.c AND m.n = t.i GROUP BY t.dataset, t.c),
    assigned AS (SELECT dataset, x.a, x.b, x.d FROM best, unnest(got) AS u(x))"""


@query("JN16_optimal_assignment", f"WITH RECURSIVE {GT}, {pairs_sql(2.0, 0, 'pts', 'gt')}, {ASSIGNED} SELECT dataset, a, b, round(d, 6) AS d FROM assigned")
def optimal_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most matches within 2 um, then least total distance."""
    got = _assigned(spark, sf_dir, 2.0)
    return got.select("dataset", "a", "b", F.round("cost", 6).alias("d"))


@query("JN17_assignment_gated_after")
def assignment_gated_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least total distance within a wide reach, and the gate only on its result."""
    got = _assigned(spark, sf_dir, 3.0)
    return got.where("cost <= 1.0").select("dataset", "a", "b", F.round("cost", 6).alias("d"))


@query(
    "JN18_assignment_prefiltered",
    f"""WITH RECURSIVE {GT}, {pairs_sql(6.0, 0, 'pts', 'pts', 'wide')}, crowd AS (SELECT * FROM pts WHERE (dataset, node_id) IN (SELECT (dataset, a) FROM wide WHERE a <> b)), {pairs_sql(2.0, 0, 'crowd', 'gt')},
    {ASSIGNED} SELECT dataset, a, b, round(d, 6) AS d FROM assigned""",
)
def assignment_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    got = _assigned(spark, sf_dir, 2.0, spatial.distance_semi(p, p, 6.0))
    return got.select("dataset", "a", "b", F.round("cost", 6).alias("d"))


@query(
    "JN22_velocity_predictor",
    f"""WITH {TRACKS} SELECT a.user_id, a.d, round(b.v + 0.5 * (b.v - c.v), 6) AS predicted, round(a.v - (b.v + 0.5 * (b.v - c.v)), 6) AS residual
    FROM tracks a JOIN tracks b ON b.user_id = a.user_id AND b.d = a.d - 1 JOIN tracks c ON c.user_id = a.user_id AND c.d = a.d - 2""",
)
def velocity_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("d")
    t = tracks(spark, sf_dir).withColumns({"v1": F.lag("v", 1).over(w), "d1": F.lag("d", 1).over(w), "v2": F.lag("v", 2).over(w), "d2": F.lag("d", 2).over(w)})
    t = t.where("d1 = d - 1 and d2 = d - 2").withColumn("p", F.col("v1") + 0.5 * (F.col("v1") - F.col("v2")))
    return t.select("user_id", "d", F.round("p", 6).alias("predicted"), F.round(F.col("v") - F.col("p"), 6).alias("residual"))


GREEDY = f"""WITH RECURSIVE {GT}, {pairs_sql(2.0, 0, 'pts', 'gt')}, r AS (SELECT dataset, a, b, d, row_number() OVER (PARTITION BY dataset ORDER BY d, a, b) AS i FROM near),
    go AS (SELECT dataset, 0::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS d FROM (SELECT DISTINCT dataset FROM r)
        UNION ALL SELECT r.dataset, r.i, CASE WHEN f.ok THEN list_append(ua, r.a) ELSE ua END, CASE WHEN f.ok THEN list_append(ub, r.b) ELSE ub END,
            CASE WHEN f.ok THEN r.a END, CASE WHEN f.ok THEN r.b END, CASE WHEN f.ok THEN r.d END
        FROM go JOIN r ON r.dataset = go.dataset AND r.i = go.i + 1, LATERAL (SELECT NOT list_contains(ua, r.a) AND NOT list_contains(ub, r.b) AS ok) f)
    SELECT dataset, a, b, round(d, 6) AS d FROM go WHERE a IS NOT NULL"""


@query("JN23_greedy_one_to_one", GREEDY)
def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.radius_join(points(spark, sf_dir), ground_truth(spark, sf_dir), 2.0)
    got = assign.greedy_one_to_one(pairs.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "d"))
    return got.select("dataset", "a", "b", F.round("d", 6).alias("d"))


@query(
    "JN24_ambiguity_margin",
    f"""WITH {PTS}, {pairs_sql(6.0, 1)}, r AS (SELECT *, row_number() OVER w AS k, lead(d) OVER w - d AS margin FROM near WINDOW w AS (PARTITION BY dataset, a ORDER BY d, b))
    SELECT dataset, a, b, round(margin, 6) AS margin FROM r WHERE k = 1 AND (margin IS NULL OR margin >= 0.5)""",
)
def ambiguity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    w = Window.partitionBy("dataset", "a_node_id").orderBy("d", "b_node_id")
    r = spatial.radius_join(p, p, 6.0, 1).withColumns({"k": F.row_number().over(w), "margin": F.lead("d").over(w) - F.col("d")})
    r = r.where("k = 1 and (margin is null or margin >= 0.5)")
    return r.select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), F.round("margin", 6).alias("margin"))


@query(
    "JN25_reciprocal_swap",
    f"""WITH {PTS}, {pairs_sql(6.0, 1)}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, a ORDER BY d, b) AS k FROM near),
    p AS (SELECT x.dataset, x.a, x.b AS cur, y.b AS alt FROM r x JOIN r y ON x.dataset = y.dataset AND x.a = y.a AND x.k = 1 AND y.k = 2)
    SELECT p.dataset, p.a AS a1, q.a AS a2 FROM p JOIN p q ON p.dataset = q.dataset AND p.alt = q.cur AND q.alt = p.cur AND p.a < q.a""",
)
def reciprocal_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources whose second choices are each other's first."""
    p = points(spark, sf_dir)
    k = spatial.knn_join(p, p, 2, 6.0, 1)
    prop = k.groupBy("dataset", F.col("a_node_id").alias("a")).agg(F.max(F.when(F.col("rank") == 1, F.col("b_node_id"))).alias("cur"), F.max(F.when(F.col("rank") == 2, F.col("b_node_id"))).alias("alt")).where("alt is not null")
    q = prop.select("dataset", F.col("a").alias("a2"), F.col("cur").alias("alt"), F.col("alt").alias("cur"))
    return prop.join(q, ["dataset", "alt", "cur"]).where("a < a2").select("dataset", F.col("a").alias("a1"), "a2")


sql_query(
    "JN27_frozen_consecutive",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, sha2(text, 256) = lag(sha2(text, 256)) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM {conversations}) WHERE same""",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, text = lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations) WHERE same",
)
@query(
    "JN28_as_of_join",
    """SELECT p.event_id, arg_max(v.event_id, {'ts': v.ts, 'id': v.event_id}) AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id""",
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of the same user at or before each purchase: one window, linear in a user's events."""
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(upto)
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("last", last)
    return e.where("event_type = 'purchase' and last is not null").select("event_id", F.col("last.event_id").alias("view_id"))


sql_query(
    "JN29_consensus_paths",
    """SELECT a.l_partkey AS start_key, a.l_suppkey AS end_key, a.q AS left_q, b.q AS right_q, round((a.q + b.q) / 2, 6) AS mid
    FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_partkey, l_suppkey) a
    JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey) b
    ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""",
)


@query(
    "JN30_chunk_owned_union",
    f"WITH {TRACKS} SELECT DISTINCT a.user_id, a.d, a.d // 7 AS chunk FROM tracks a JOIN tracks b ON b.user_id = a.user_id AND b.d = a.d + 1",
)
def chunk_owned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of consecutive days found in weekly chunks that overlap by a day; a chunk owns the pairs it starts."""
    t = tracks(spark, sf_dir).select("user_id", "d")
    inside = t.select("user_id", "d", F.explode(F.array_distinct(F.array(F.floor(F.col("d") / 7), F.floor((F.col("d") - 1) / 7)))).alias("chunk"))
    after = inside.select("user_id", (F.col("d") - 1).alias("d"), "chunk")
    pairs = inside.join(after, ["user_id", "d", "chunk"]).where(F.floor(F.col("d") / 7) == F.col("chunk"))
    return pairs.select("user_id", "d", F.col("chunk").cast("int").alias("chunk")).distinct()
