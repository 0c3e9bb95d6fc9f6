"""Metrics, aggregations and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import adjusted_jaccard, jaccard
from ..operators import assign, spatial
from ..sources import candidate_edges, ground_truth, points, table, tracks
from .base import CAND, GT, PTS, TRACKS, pairs_sql, query, sql_query
from .graphs import LINKS, links
from .joins import GREEDY

MATCH = GREEDY[: GREEDY.rindex("SELECT dataset, a, b")].rstrip()
CONFUSION = f"""{MATCH}, m AS (SELECT dataset, a, b FROM go WHERE a IS NOT NULL),
    {pairs_sql(6.0, 1, name='pn')}, pe AS (SELECT dataset, a AS s, arg_min(b, {{'d': d, 'b': b}}) AS t FROM pn GROUP BY dataset, a),
    {pairs_sql(9.0, 1, 'gt', 'gt', 'gn')}, ge AS (SELECT dataset, a AS s, arg_min(b, {{'d': d, 'b': b}}) AS t FROM gn GROUP BY dataset, a),
    j AS (SELECT pe.dataset, ms.b AS gs, mt.b AS g2, coalesce(ge.t = mt.b, false) AS hit, gs.s IS NOT NULL AS ks, gt_.t IS NOT NULL AS kt FROM pe
        LEFT JOIN m ms ON ms.dataset = pe.dataset AND ms.a = pe.s LEFT JOIN m mt ON mt.dataset = pe.dataset AND mt.a = pe.t
        LEFT JOIN ge ON ge.dataset = pe.dataset AND ge.s = ms.b LEFT JOIN (SELECT DISTINCT dataset, s FROM ge) gs ON gs.dataset = pe.dataset AND gs.s = ms.b
        LEFT JOIN (SELECT DISTINCT dataset, t FROM ge) gt_ ON gt_.dataset = pe.dataset AND gt_.t = mt.b),
    c AS (SELECT j.dataset, count(*) FILTER (WHERE hit)::BIGINT AS tp, count(*) FILTER (WHERE NOT hit AND (ks OR kt))::BIGINT AS fp,
        any_value(n.n) - count(DISTINCT CASE WHEN hit THEN gs END) AS fn FROM j JOIN (SELECT dataset, count(*) AS n FROM ge GROUP BY dataset) n ON n.dataset = j.dataset GROUP BY j.dataset)"""


def _next_links(p: DataFrame, radius: float) -> DataFrame:
    return spatial.nearest_join(p, p, radius, 1).select("dataset", F.col("a_node_id").alias("s"), F.col("b_node_id").alias("t"))


def edge_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted links with their matched ends, and the true links."""
    p, g = points(spark, sf_dir), ground_truth(spark, sf_dir)
    pairs = spatial.radius_join(p, g, 2.0).select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "d")
    m = assign.greedy_one_to_one(pairs)
    pe, ge = _next_links(p, 6.0), _next_links(g, 9.0)
    side = lambda k, v: m.select("dataset", F.col("a").alias(k), F.col("b").alias(v))
    j = pe.join(side("s", "gs"), ["dataset", "s"], "left").join(side("t", "g2"), ["dataset", "t"], "left")
    j = j.join(ge.select("dataset", F.col("s").alias("gs"), F.col("t").alias("true_t")), ["dataset", "gs"], "left")
    ends = ge.select("dataset", F.col("t").alias("g2")).distinct().withColumn("kt", F.lit(True))
    j = j.join(ends, ["dataset", "g2"], "left")
    hit = F.coalesce(F.col("true_t") == F.col("g2"), F.lit(False))
    return j.select("dataset", "s", "t", "gs", "g2", hit.alias("hit"), F.col("true_t").isNotNull().alias("ks"), F.coalesce("kt", F.lit(False)).alias("kt")), ge


def edge_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, ge = edge_rows(spark, sf_dir)
    c = j.groupBy("dataset").agg(
        F.count_if("hit").alias("tp"), F.count_if(~F.col("hit") & (F.col("ks") | F.col("kt"))).alias("fp"), F.countDistinct(F.when(F.col("hit"), F.col("gs"))).alias("found")
    )
    c = c.join(ge.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "dataset")
    return c.select("dataset", "tp", "fp", (F.col("n") - F.col("found")).alias("fn"))


@query("AG01_edge_confusion", f"{CONFUSION} SELECT dataset, tp, fp, fn, round(tp / (tp + fp + fn), 6) AS edge_jaccard FROM c")
def edge_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links matched to true links under sparse truth: an unmatched link is wrong only where truth says something."""
    c = edge_confusion_counts(spark, sf_dir)
    return c.withColumn("edge_jaccard", F.round(jaccard(F.col("tp"), F.col("fp"), F.col("fn")), 6))


@query(
    "AG03_adjusted_jaccard",
    f"""{CONFUSION}, n AS (SELECT dataset, count(*) AS n FROM pts GROUP BY dataset), g AS (SELECT dataset, count(*) * 2 AS t FROM gt GROUP BY dataset)
    SELECT c.dataset, round(greatest(0, tp / (tp + fp + fn) * (1 - 0.1 * (n.n - g.t) / g.t)), 6) AS adjusted FROM c JOIN n USING (dataset) JOIN g USING (dataset)""",
)
def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = edge_confusion_counts(spark, sf_dir).join(points(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "dataset")
    c = c.join(ground_truth(spark, sf_dir).groupBy("dataset").agg((F.count(F.lit(1)) * 2).alias("true")), "dataset")
    return c.select("dataset", F.round(adjusted_jaccard(jaccard(F.col("tp"), F.col("fp"), F.col("fn")), F.col("n"), F.col("true")), 6).alias("adjusted"))


@query(
    "AG05_error_decomposition",
    f"""{CONFUSION} SELECT dataset, CASE WHEN hit THEN 'recovered' WHEN gs IS NULL AND g2 IS NULL THEN 'spurious' WHEN gs IS NULL OR g2 IS NULL THEN 'half' ELSE 'wrong' END AS kind, count(*) AS n FROM j GROUP BY 1, 2""",
)
def error_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, _ = edge_rows(spark, sf_dir)
    lost_s, lost_t = F.col("gs").isNull(), F.col("g2").isNull()
    kind = F.when(F.col("hit"), "recovered").when(lost_s & lost_t, "spurious").when(lost_s | lost_t, "half").otherwise("wrong")
    return j.groupBy("dataset", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


sql_query("AG02_jaccard", """SELECT l_returnflag, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0 END, 6) AS jaccard FROM
    (SELECT l_returnflag, count_if(l_quantity > 25) AS a, count_if(l_discount > 0.05) AS b, count_if(l_tax > 0.04) AS c FROM {lineitem} GROUP BY l_returnflag)""")
sql_query("AG06_category_sums", """SELECT o_orderpriority AS category, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderpriority""")
sql_query("AG07_per_sample_row", """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count_if(o_orderstatus = 'F') AS filled FROM {orders} GROUP BY o_custkey""",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count_if(o_orderstatus = 'F')::BIGINT AS filled FROM orders GROUP BY o_custkey""")
sql_query("AG08_weighted_mean", """SELECT l_shipmode_proxy AS grp, round(sum(w * x) / sum(w), 6) AS weighted FROM (SELECT l_linestatus AS l_shipmode_proxy, l_discount AS x, CASE WHEN l_quantity = 0 THEN 1 ELSE l_quantity END AS w FROM {lineitem}) GROUP BY l_shipmode_proxy""")
sql_query("AG09_overlapping_groups", """SELECT g.grp, count(*) AS n, round(avg(o.o_totalprice), 4) AS mean FROM {orders} o JOIN (VALUES ('all', 0.0D), ('large', 200000.0D), ('huge', 300000.0D)) AS g(grp, least_price) ON o.o_totalprice >= g.least_price GROUP BY g.grp""",
    "SELECT g.grp, count(*) AS n, round(avg(o.o_totalprice), 4) AS mean FROM orders o JOIN (VALUES ('all', 0.0), ('large', 200000.0), ('huge', 300000.0)) AS g(grp, least_price) ON o.o_totalprice >= g.least_price GROUP BY g.grp")
sql_query("AG09_grouping_sets", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
sql_query("AG10_wins_and_losses", """SELECT count_if(b.v - a.v > 1e-9) AS wins, count_if(a.v - b.v > 1e-9) AS losses, round(sum(b.v - a.v), 4) AS delta FROM
    (SELECT l_suppkey, avg(l_discount) AS v FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY l_suppkey) a JOIN (SELECT l_suppkey, avg(l_discount) AS v FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey) b ON a.l_suppkey = b.l_suppkey""",
    """SELECT count_if(b.v - a.v > 1e-9)::BIGINT AS wins, count_if(a.v - b.v > 1e-9)::BIGINT AS losses, round(sum(b.v - a.v), 4) AS delta FROM
    (SELECT l_suppkey, avg(l_discount) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey) a JOIN (SELECT l_suppkey, avg(l_discount) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) b ON a.l_suppkey = b.l_suppkey""")
sql_query("AG11_linear_calibration", "SELECT o_orderkey, round(0.298 * (o_totalprice / 500000) + 0.668, 6) AS calibrated FROM {orders}")
sql_query("AG12_percentiles", """SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS p50, round(percentile(l_extendedprice, 0.9), 4) AS p90, round(percentile(l_extendedprice, 0.99), 4) AS p99,
    round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd FROM {lineitem} GROUP BY l_returnflag""",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
    round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag""")


@query(
    "AG13_median_and_incoherence",
    f"""WITH {PTS}, m AS (SELECT dataset, t, median(z) AS mz, median(y) AS my, median(x) AS mx FROM pts GROUP BY dataset, t)
    SELECT p.dataset, p.t, round(any_value(mz), 6) AS mz, round(any_value(my), 6) AS my, round(any_value(mx), 6) AS mx, round(median(sqrt((z-mz)*(z-mz)+(y-my)*(y-my)+(x-mx)*(x-mx))), 6) AS incoherence
    FROM pts p JOIN m ON m.dataset = p.dataset AND m.t = p.t GROUP BY p.dataset, p.t""",
)
def median_and_incoherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = p.groupBy("dataset", "t").agg(*(F.percentile(c, F.lit(0.5)).alias("m" + c) for c in "zyx"))
    far = F.sqrt(sum(((F.col(c) - F.col("m" + c)) * (F.col(c) - F.col("m" + c)) for c in "yx"), (F.col("z") - F.col("mz")) * (F.col("z") - F.col("mz"))))
    out = p.join(m, ["dataset", "t"]).groupBy("dataset", "t").agg(*(F.round(F.first("m" + c), 6).alias("m" + c) for c in "zyx"), F.round(F.percentile(far, F.lit(0.5)), 6).alias("incoherence"))
    return out


sql_query("AG14_sweep", """SELECT v.tau, count_if(l_discount >= v.tau) AS kept, round(sum(CASE WHEN l_discount >= v.tau THEN l_quantity ELSE 0 END) / greatest(count_if(l_discount >= v.tau), 1), 6) AS mean_q
    FROM {lineitem} CROSS JOIN (VALUES (0.0D), (0.03D), (0.06D), (0.09D), (1.0D)) AS v(tau) GROUP BY v.tau""",
    """SELECT v.tau::DOUBLE AS tau, count_if(l_discount >= v.tau)::BIGINT AS kept, round(sum(CASE WHEN l_discount >= v.tau THEN l_quantity ELSE 0 END) / greatest(count_if(l_discount >= v.tau), 1), 6) AS mean_q
    FROM lineitem CROSS JOIN (VALUES (0.0::DOUBLE), (0.03), (0.06), (0.09), (1.0)) AS v(tau) GROUP BY v.tau""")
sql_query("AG15_bin_rates", """SELECT bin, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 0.0D END), 6) AS rate, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, l_returnflag FROM {lineitem}) GROUP BY bin""",
    """SELECT bin, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate, round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM (SELECT floor(l_quantity / 10)::BIGINT AS bin, l_returnflag FROM lineitem) GROUP BY bin""")
sql_query("AG16_rule_table", """SELECT rule, count_if(hit) AS n, round(count_if(hit) / count(*), 6) AS share FROM (SELECT stack(3, 'long', n_chars > 5000, 'english', lang = 'en', 'hot', source = 'src0') AS (rule, hit) FROM {documents}) GROUP BY rule""",
    """SELECT rule, count_if(hit)::BIGINT AS n, round(count_if(hit) / count(*), 6) AS share FROM (SELECT unnest(['long', 'english', 'hot']) AS rule, unnest([n_chars > 5000, lang = 'en', source = 'src0']) AS hit FROM documents) GROUP BY rule""")
sql_query("AG17_count_of_counts", "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) GROUP BY n")
sql_query("AG18_distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS ids FROM {events} GROUP BY event_type")
sql_query("AG19_mean_of_views", "SELECT l_partkey, l_suppkey, count(*) AS n_views, round(avg(l_discount), 6) AS mean FROM {lineitem} GROUP BY l_partkey, l_suppkey")


@query("AG20_max_probability", f"WITH {CAND} SELECT dataset, target_id, max(edge_prob) AS p FROM cand GROUP BY dataset, target_id")
def max_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_edges(spark, sf_dir).groupBy("dataset", "target_id").agg(F.max("edge_prob").alias("p"))


RANKED = "r AS (SELECT o_custkey AS grp, o_orderstatus = 'F' AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders})"
sql_query("AG21_ranking_metrics", f"""WITH {RANKED}, b AS (SELECT grp, min(CASE WHEN label THEN k END) AS first_hit FROM r GROUP BY grp)
    SELECT count(*) AS groups, round(avg(CASE WHEN first_hit = 1 THEN 1.0D ELSE 0.0D END), 6) AS top1, round(avg(CASE WHEN first_hit <= 2 THEN 1.0D ELSE 0.0D END), 6) AS top2, round(avg(1 / first_hit), 6) AS mrr FROM b WHERE first_hit IS NOT NULL""",
    f"""WITH {RANKED.replace('{orders}', 'orders')}, b AS (SELECT grp, min(CASE WHEN label THEN k END) AS first_hit FROM r GROUP BY grp)
    SELECT count(*) AS groups, round(avg(CASE WHEN first_hit = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN first_hit <= 2 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS top2, round(avg(1 / first_hit), 6) AS mrr FROM b WHERE first_hit IS NOT NULL""")
sql_query("AG22_winner_comparison", """WITH w AS (SELECT o_custkey, max_by(o_orderstatus, struct(o_totalprice, o_orderkey)) AS old, max_by(o_orderstatus, struct(o_totalprice * (1 + o_orderkey % 3), o_orderkey)) AS new FROM {orders} GROUP BY o_custkey)
    SELECT count_if(old <> 'F' AND new = 'F') AS fixes, count_if(old = 'F' AND new <> 'F') AS breaks, count_if(old <> new) AS changes FROM w""",
    """WITH w AS (SELECT o_custkey, arg_max(o_orderstatus, {'p': o_totalprice, 'k': o_orderkey}) AS old, arg_max(o_orderstatus, {'p': o_totalprice * (1 + o_orderkey % 3), 'k': o_orderkey}) AS new FROM orders GROUP BY o_custkey)
    SELECT count_if(old <> 'F' AND new = 'F')::BIGINT AS fixes, count_if(old = 'F' AND new <> 'F')::BIGINT AS breaks, count_if(old <> new)::BIGINT AS changes FROM w""")
sql_query("AG23_robust_aggregate", "SELECT l_returnflag, round(min(m), 6) AS least, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(l_discount) AS m FROM {lineitem} GROUP BY l_returnflag, l_suppkey) GROUP BY l_returnflag")
SCORED = "(SELECT event_id, (event_id % 997) / 997 AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM {events})"
sql_query("AG24_precision_recall", f"""SELECT v.tau, round(count_if(score >= v.tau AND y = 1) / greatest(count_if(score >= v.tau), 1), 6) AS prec, round(count_if(score >= v.tau AND y = 1) / greatest(count_if(y = 1), 1), 6) AS recall
    FROM {SCORED} CROSS JOIN (VALUES (0.1D), (0.5D), (0.9D)) AS v(tau) GROUP BY v.tau""",
    f"""SELECT v.tau::DOUBLE AS tau, round(count_if(score >= v.tau AND y = 1) / greatest(count_if(score >= v.tau), 1), 6) AS prec, round(count_if(score >= v.tau AND y = 1) / greatest(count_if(y = 1), 1), 6) AS recall
    FROM {SCORED.replace('{events}', 'events')} CROSS JOIN (VALUES (0.1::DOUBLE), (0.5), (0.9)) AS v(tau) GROUP BY v.tau""")


@query("AG25_average_precision", f"SELECT round(avg(hits / k), 6) AS ap FROM (SELECT y, sum(y) OVER w AS hits, row_number() OVER w AS k FROM {SCORED.replace('{events}', 'events')} WINDOW w AS (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING)) WHERE y = 1")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision from counts of score levels: running sums meet only once for each of at most 997 levels."""
    s = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 997).alias("level"), (F.col("event_type") == "purchase").cast("long").alias("y"))
    inside = Window.partitionBy("level").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"k0": F.row_number().over(inside), "h0": F.sum("y").over(inside)})
    levels = s.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    above = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("level", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p"))
    s = s.join(levels, "level").where("y = 1")
    return s.agg(F.round(F.avg((F.col("h0") + F.col("p")) / (F.col("k0") + F.col("n"))), 6).alias("ap"))


@query(
    "AG26_roc_auc",
    f"""WITH s AS (SELECT score, count(*) AS n, sum(y) AS p FROM {SCORED.replace('{events}', 'events')} GROUP BY score), r AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2 AS rank FROM s)
    SELECT round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 6) AS auc FROM r""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-sum area from one row for each distinct score."""
    s = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 997).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("p"))
    r = s.withColumn("rank", F.sum("n").over(Window.orderBy("level")) - F.col("n") + (F.col("n") + 1) / 2)
    p, n = F.sum("p"), F.sum("n")
    return r.agg(F.round((F.sum(F.col("rank") * F.col("p")) - p * (p + 1) / 2) / (p * (n - p)), 6).alias("auc"))


@query(
    "AG27_threshold_selection",
    """WITH g AS (SELECT event_id % 997 AS level, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS fix, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS brk FROM events GROUP BY 1),
    c AS (SELECT level, sum(fix) OVER w AS fixes, sum(brk) OVER w AS breaks FROM g WINDOW w AS (ORDER BY level DESC))
    SELECT arg_max(level, {'n': fixes - breaks, 'l': level}) AS level, max(fixes - breaks)::BIGINT AS net FROM c""",
)
def threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score level from which fixes exceed breaks most."""
    e = table(spark, sf_dir, "events")
    one = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    g = e.groupBy((F.col("event_id") % 997).alias("level")).agg((one("click") - one("error")).alias("net"))
    run = g.withColumn("net", F.sum("net").over(Window.orderBy(F.col("level").desc())))
    return run.agg(F.max_by("level", F.struct("net", "level")).alias("level"), F.max("net").alias("net"))


sql_query("AG28_ols_by_group", "SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 8) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept, round(regr_r2(o_totalprice, o_custkey), 8) AS r2 FROM {orders} GROUP BY o_orderpriority")
sql_query("AG29_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag")


@query(
    "AG30_subsample_sensitivity",
    """WITH d AS (SELECT i AS draw, doc_id, n_chars, row_number() OVER (PARTITION BY i, source ORDER BY md5(doc_id::VARCHAR || '-' || i::VARCHAR), doc_id) AS k, source FROM documents, range(20) r(i))
    SELECT draw::BIGINT AS draw, round(avg(n_chars), 6) AS mean FROM d WHERE k <= 10 GROUP BY draw""",
)
def subsample_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of seeded draws of ten documents of each source; the sampling is the operator."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("draw").cast("string")))
    k = F.row_number().over(Window.partitionBy("draw", "source").orderBy(key, "doc_id"))
    return d.withColumn("k", k).where("k <= 10").groupBy("draw").agg(F.round(F.avg("n_chars"), 6).alias("mean"))


sql_query("AG31_dashboard_counters", "SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, round(max(value), 6) AS best, count_if(value > 50) AS high FROM {events} GROUP BY ROLLUP (event_type)",
    "SELECT coalesce(event_type, 'all') AS kind, count(*) AS n, round(max(value), 6) AS best, count_if(value > 50)::BIGINT AS high FROM events GROUP BY ROLLUP (event_type)")
sql_query("AG32_stage_counters", """SELECT 'lines' AS stage, count(*) AS n FROM {lineitem} UNION ALL SELECT 'returned', count(*) FROM {lineitem} WHERE l_returnflag = 'R' UNION ALL SELECT 'returned_discounted', count(*) FROM {lineitem} WHERE l_returnflag = 'R' AND l_discount > 0.05""")


@query(
    "AG33_coverage_shares",
    f"WITH {GT}, {pairs_sql(1.0, 0, 'gt', 'pts')} SELECT g.dataset, count(*) AS n, count_if((g.dataset, g.node_id) IN (SELECT (dataset, a) FROM near))::BIGINT AS covered FROM gt g GROUP BY g.dataset",
)
def coverage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ground_truth(spark, sf_dir)
    hit = spatial.radius_join(g, points(spark, sf_dir), 1.0).select("dataset", F.col("a_node_id").alias("node_id")).distinct().withColumn("hit", F.lit(1))
    return g.join(hit, ["dataset", "node_id"], "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("covered"))


@query(
    "AG34_jump_statistics",
    f"WITH {TRACKS}, s AS (SELECT user_id, v - lag(v) OVER (PARTITION BY user_id ORDER BY d) AS step FROM tracks) SELECT user_id, count(step) AS n, count_if(abs(step) > 50)::BIGINT AS jumps, round(max(abs(step)), 6) AS largest FROM s GROUP BY user_id",
)
def jump_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tracks(spark, sf_dir).withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("d")))
    return s.groupBy("user_id").agg(F.count("step").alias("n"), F.count_if(F.abs("step") > 50).alias("jumps"), F.round(F.max(F.abs("step")), 6).alias("largest"))


sql_query("AG35_before_after", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS before, round(avg(l_extendedprice * (1 - l_discount)), 4) AS after, round(avg(l_extendedprice * (1 - l_discount)) / avg(l_extendedprice) - 1, 6) AS change FROM {lineitem} GROUP BY l_returnflag")
sql_query("AG36_config_diff", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, '<unset>') AS old, coalesce(b.v, '<unset>') AS new FROM (SELECT CAST(c_custkey AS STRING) AS k, c_mktsegment AS v FROM {customer} WHERE c_custkey % 7 <> 0) a
    FULL JOIN (SELECT CAST(c_custkey AS STRING) AS k, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS v FROM {customer} WHERE c_custkey % 5 <> 0) b ON a.k = b.k WHERE coalesce(a.v, '<unset>') <> coalesce(b.v, '<unset>')""")


@query(
    "AG37_fork_outcomes",
    f"WITH {CAND}, d AS (SELECT dataset, source_id, count(*) AS n FROM cand GROUP BY 1, 2) SELECT p.dataset, CASE WHEN n IS NULL THEN 'end' WHEN n = 1 THEN 'link' WHEN n = 2 THEN 'fork' ELSE 'many' END AS outcome, count(*) AS n FROM pts p LEFT JOIN d ON d.dataset = p.dataset AND d.source_id = p.node_id GROUP BY 1, 2",
)
def fork_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candidate_edges(spark, sf_dir).groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k")
    out = F.when(k.isNull(), "end").when(k == 1, "link").when(k == 2, "fork").otherwise("many").alias("outcome")
    return points(spark, sf_dir).join(d, ["dataset", "node_id"], "left").groupBy("dataset", out).agg(F.count(F.lit(1)).alias("n"))


@query(
    "AG38_run_differences",
    f"""WITH {GT}, {pairs_sql(2.0, 0, 'gt', 'pts')}, m AS (SELECT dataset, a, arg_min(b, {{'d': d, 'b': b}}) AS b, min(d) AS d FROM near GROUP BY dataset, a)
    SELECT dataset, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS most FROM m GROUP BY dataset""",
)
def run_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.nearest_join(ground_truth(spark, sf_dir), points(spark, sf_dir), 2.0, other=False)
    return m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.percentile("d", F.lit(q)), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))), F.round(F.max("d"), 6).alias("most"))


sql_query("AG39_quality_gates", "SELECT l_suppkey, count(*) AS n, bool_and(l_discount <= 0.1) AS all_small FROM {lineitem} GROUP BY l_suppkey HAVING count(*) >= 600 OR bool_or(l_quantity > 49)")
sql_query("AG40_rank_thresholds", """SELECT v.tau, count_if(o_totalprice >= v.tau) AS n, max(CASE WHEN o_totalprice >= v.tau THEN o_orderkey END) AS worst FROM {orders} CROSS JOIN (VALUES (100000.0D), (200000.0D), (400000.0D)) AS v(tau) GROUP BY v.tau""",
    """SELECT v.tau::DOUBLE AS tau, count_if(o_totalprice >= v.tau)::BIGINT AS n, max(CASE WHEN o_totalprice >= v.tau THEN o_orderkey END) AS worst FROM orders CROSS JOIN (VALUES (100000.0::DOUBLE), (200000.0), (400000.0)) AS v(tau) GROUP BY v.tau""")


@query("AG04_division_confusion", f"WITH {LINKS}, {pairs_sql(4.0, 1, name='c4')}, f AS (SELECT dataset, a, count(*) AS n FROM c4 GROUP BY 1, 2) SELECT f.dataset, count_if(n >= 2 AND l.source_id IS NOT NULL)::BIGINT AS tp, count_if(n >= 2 AND l.source_id IS NULL)::BIGINT AS fp, count_if(n < 2 AND l.source_id IS NOT NULL)::BIGINT AS fn FROM f LEFT JOIN link l ON l.dataset = f.dataset AND l.source_id = f.a GROUP BY f.dataset")
def division_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks among candidate links against nodes whose own link is certain."""
    f = candidate_edges(spark, sf_dir).groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("n"))
    hit = links(spark, sf_dir).select("dataset", "source_id").withColumn("hit", F.lit(True))
    f = f.join(hit, ["dataset", "source_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    two = F.col("n") >= 2
    return f.groupBy("dataset").agg(F.count_if(two & F.col("hit")).alias("tp"), F.count_if(two & ~F.col("hit")).alias("fp"), F.count_if(~two & F.col("hit")).alias("fn"))
