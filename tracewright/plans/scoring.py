"""The scorer: predicted lineages against sparse true ones, from matched nodes to one row for each movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import adjusted_jaccard, jaccard
from ..operators import assign, graph, spatial
from ..operators.shared import checkpointed, shared_path
from ..sources import ground_truth, points
from .base import pairs_sql, query
from .joins import GREEDY

#: Gates in um: matching of predicted and true nodes, links of the predicted and of the true graph.
MATCH_UM, PREDICTED_UM, TRUE_UM = 0.05, 4.0, 9.0
#: Weight of the division term, and of a surplus of nodes.
DIVISION_WEIGHT, NODE_WEIGHT = 0.1, 0.1
ERRORS = ("missed_gt_nodes", "spurious_pred_nodes", "edges_recovered", "edges_fragmented", "edges_lost_to_detection", "wrong_association_edges")


def _family_sql(name: str, of: str, radius: float) -> str:
    return f"""{pairs_sql(radius, 1, of, of, name + 'n')}, {name}b AS (SELECT dataset, b AS t, arg_min(a, {{'d': d, 'a': a}}) AS s, min(d) AS d FROM {name}n GROUP BY dataset, b),
    {name} AS (SELECT dataset, s, t FROM (SELECT *, row_number() OVER (PARTITION BY dataset, s ORDER BY d, t) AS k FROM {name}b) WHERE k <= 2)"""


SCORED = f"""{GREEDY[: GREEDY.rindex("SELECT dataset, a, b")].rstrip().replace(pairs_sql(2.0, 0, 'pts', 'gt'), pairs_sql(MATCH_UM, 0, 'pts', 'gt'))},
    m AS (SELECT dataset, a, b FROM go WHERE a IS NOT NULL), {_family_sql('pe', 'pts', PREDICTED_UM)}, {_family_sql('ge', 'gt', TRUE_UM)},
    j AS (SELECT pe.dataset, pe.s, pe.t, ms.b AS gs, mt.b AS gt_, h.s IS NOT NULL AS hit,
            EXISTS (SELECT 1 FROM ge WHERE ge.dataset = pe.dataset AND ge.s = ms.b) OR EXISTS (SELECT 1 FROM ge WHERE ge.dataset = pe.dataset AND ge.t = mt.b) AS known
        FROM pe LEFT JOIN m ms ON ms.dataset = pe.dataset AND ms.a = pe.s LEFT JOIN m mt ON mt.dataset = pe.dataset AND mt.a = pe.t
        LEFT JOIN ge h ON h.dataset = pe.dataset AND h.s = ms.b AND h.t = mt.b),
    k AS (SELECT ge.dataset, ms.a IS NOT NULL AS has_s, mt.a IS NOT NULL AS has_t, pe.s IS NOT NULL AS found
        FROM ge LEFT JOIN m ms ON ms.dataset = ge.dataset AND ms.b = ge.s LEFT JOIN m mt ON mt.dataset = ge.dataset AND mt.b = ge.t
        LEFT JOIN pe ON pe.dataset = ge.dataset AND pe.s = ms.a AND pe.t = mt.a)"""

DIVIDED = f"""{SCORED}, nb AS (SELECT dataset, s AS a, t AS b FROM pe UNION SELECT dataset, t, s FROM pe),
    reach AS (SELECT dataset, node_id, node_id AS r FROM pts UNION SELECT reach.dataset, reach.node_id, nb.b FROM reach JOIN nb ON nb.dataset = reach.dataset AND nb.a = reach.r),
    comp AS (SELECT dataset, node_id, min(r) AS c FROM reach GROUP BY dataset, node_id), gc AS (SELECT m.dataset, m.b AS g, comp.c FROM m JOIN comp ON comp.dataset = m.dataset AND comp.node_id = m.a),
    up AS (SELECT dataset, g, c FROM gc UNION SELECT up.dataset, ge.s, up.c FROM up JOIN ge ON ge.dataset = up.dataset AND ge.t = up.g),
    pf AS (SELECT dataset, s FROM pe GROUP BY dataset, s HAVING count(*) >= 2), fc AS (SELECT DISTINCT pf.dataset, comp.c FROM pf JOIN comp ON comp.dataset = pf.dataset AND comp.node_id = pf.s),
    dv AS (SELECT dataset, s, min(t) AS d1, max(t) AS d2 FROM ge GROUP BY dataset, s HAVING count(*) = 2),
    an AS (SELECT dv.*, gc.c FROM dv JOIN gc ON gc.dataset = dv.dataset AND gc.g = dv.s UNION SELECT dv.*, gc.c FROM dv JOIN ge ON ge.dataset = dv.dataset AND ge.t = dv.s JOIN gc ON gc.dataset = dv.dataset AND gc.g = ge.s),
    ok AS (SELECT DISTINCT an.dataset, an.s FROM an JOIN fc USING (dataset, c) JOIN up x ON x.dataset = an.dataset AND x.g = an.d1 AND x.c = an.c JOIN up y ON y.dataset = an.dataset AND y.g = an.d2 AND y.c = an.c),
    df AS (SELECT DISTINCT pf.dataset, pf.s FROM pf JOIN m ON m.dataset = pf.dataset AND m.a = pf.s JOIN ge ON ge.dataset = pf.dataset AND ge.s = m.b WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.dataset = pf.dataset AND ok.s = m.b)),
    ds AS (SELECT DISTINCT dataset FROM pts),
    div AS (SELECT dataset, (SELECT count(*) FROM ok WHERE ok.dataset = ds.dataset) AS div_tp, (SELECT count(*) FROM df WHERE df.dataset = ds.dataset) AS div_fp,
        (SELECT count(*) FROM dv WHERE dv.dataset = ds.dataset) - (SELECT count(*) FROM ok WHERE ok.dataset = ds.dataset) AS div_fn FROM ds)"""

_JACCARD = "CASE WHEN {0}_tp + {0}_fp + {0}_fn > 0 THEN {0}_tp / ({0}_tp + {0}_fp + {0}_fn) ELSE 0 END"
ROWS = f"""{DIVIDED}, ej AS (SELECT dataset, count(*) FILTER (WHERE hit)::BIGINT AS edge_tp, count(*) FILTER (WHERE NOT hit AND known)::BIGINT AS edge_fp,
        count(*) FILTER (WHERE gs IS NOT NULL AND gt_ IS NOT NULL AND NOT hit)::BIGINT AS wrong_association_edges FROM j GROUP BY dataset),
    ek AS (SELECT dataset, count(*) FILTER (WHERE NOT found)::BIGINT AS edge_fn, count(*) FILTER (WHERE found)::BIGINT AS edges_recovered, count(*) FILTER (WHERE has_s AND has_t AND NOT found)::BIGINT AS edges_fragmented,
        count(*) FILTER (WHERE NOT (has_s AND has_t))::BIGINT AS edges_lost_to_detection FROM k GROUP BY dataset),
    np AS (SELECT dataset, count(*) AS t_pred FROM pts GROUP BY dataset), ng AS (SELECT dataset, count(*) AS n FROM gt GROUP BY dataset), nm AS (SELECT dataset, count(*) AS n FROM m GROUP BY dataset),
    w AS (SELECT np.dataset, t_pred, coalesce(ng.n, 0) * 2 AS t_true, coalesce(ng.n, 0) - coalesce(nm.n, 0) AS missed_gt_nodes, t_pred - coalesce(nm.n, 0) AS spurious_pred_nodes, coalesce(edge_tp, 0) AS edge_tp, coalesce(edge_fp, 0) AS edge_fp,
        coalesce(edge_fn, 0) AS edge_fn, coalesce(edges_recovered, 0) AS edges_recovered, coalesce(edges_fragmented, 0) AS edges_fragmented, coalesce(edges_lost_to_detection, 0) AS edges_lost_to_detection,
        coalesce(wrong_association_edges, 0) AS wrong_association_edges, div_tp, div_fp, div_fn FROM np LEFT JOIN ng USING (dataset) LEFT JOIN nm USING (dataset) LEFT JOIN ej USING (dataset) LEFT JOIN ek USING (dataset) JOIN div USING (dataset)),
    x AS (SELECT *, {_JACCARD.format('edge')} AS ejac, {_JACCARD.format('div')} AS djac, edge_tp + edge_fp + edge_fn AS weight FROM w),
    rows_ AS (SELECT *, CASE WHEN t_true > 0 THEN greatest(0, ejac * (1 - {NODE_WEIGHT} * (t_pred - t_true) / t_true)) ELSE ejac END AS adj FROM x)"""


def lineages(p: DataFrame, radius: float) -> DataFrame:
    """(dataset, s, t): each point's nearest parent within ``radius``, and of each parent the two nearest children."""
    parent = spatial.radius_join(p, p, radius, 1).groupBy("dataset", F.col("b_node_id").alias("t")).agg(F.min(F.struct("d", F.col("a_node_id").alias("s"))).alias("m"))
    parent = parent.select("dataset", "m.s", "t", "m.d")
    order = Window.partitionBy("dataset", "s").orderBy("d", "t")
    return parent.withColumn("k", F.row_number().over(order)).where("k <= 2").select("dataset", "s", "t")


def matched_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(match(dataset, a, b), predicted edges, true edges), each written once."""
    p, g = points(spark, sf_dir), ground_truth(spark, sf_dir)
    near = spatial.radius_join(p, g, MATCH_UM).select("dataset", F.col("a_node_id").alias("a"), F.col("b_node_id").alias("b"), "d")
    match = assign.greedy_one_to_one(near).select("dataset", "a", "b")
    return match, checkpointed(lineages(p, PREDICTED_UM), "predicted"), checkpointed(lineages(g, TRUE_UM), "true")


def _predicted_edges(match: DataFrame, pe: DataFrame, ge: DataFrame) -> DataFrame:
    """Predicted edges with their matched ends, whether they are true, and whether truth says anything of them."""
    side = lambda k, v: match.select("dataset", F.col("a").alias(k), F.col("b").alias(v))
    flag = lambda e, c, n: e.select("dataset", F.col(c[0]).alias(c[1])).distinct().withColumn(n, F.lit(True))
    j = pe.join(side("s", "gs"), ["dataset", "s"], "left").join(side("t", "gt"), ["dataset", "t"], "left")
    j = j.join(ge.toDF("dataset", "gs", "gt").withColumn("hit", F.lit(True)), ["dataset", "gs", "gt"], "left")
    j = j.join(flag(ge, ("s", "gs"), "ks"), ["dataset", "gs"], "left").join(flag(ge, ("t", "gt"), "kt"), ["dataset", "gt"], "left")
    return j.fillna(False, ["hit", "ks", "kt"])


def _true_edges(match: DataFrame, pe: DataFrame, ge: DataFrame) -> DataFrame:
    """True edges, whether their ends are matched and whether the prediction has them."""
    side = lambda k, v: match.select("dataset", F.col("b").alias(k), F.col("a").alias(v))
    k = ge.join(side("s", "ps"), ["dataset", "s"], "left").join(side("t", "pt"), ["dataset", "t"], "left")
    k = k.join(pe.toDF("dataset", "ps", "pt").withColumn("found", F.lit(True)), ["dataset", "ps", "pt"], "left").fillna(False, ["found"])
    return k.select("dataset", F.col("ps").isNotNull().alias("has_s"), F.col("pt").isNotNull().alias("has_t"), "found")


def division_sets(nodes: DataFrame, match: DataFrame, pe: DataFrame, ge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found(dataset, s), true(dataset, s, d1, d2), wrong(dataset, s)) of predicted ``nodes(dataset, node_id)``.

    A true division is found if one predicted component with a fork holds a match of the
    parent (or of its parent) and of a descendant of either child. Components climb from
    matched nodes to their true ancestors, so a round moves distinct (node, component) only.
    """
    p = nodes.select("dataset", F.col("node_id").alias("a"))
    comp = graph.components(pe.toDF("dataset", "source_id", "target_id")).toDF("dataset", "a", "c")
    comp = p.join(comp, ["dataset", "a"], "left").select("dataset", "a", F.coalesce("c", "a").alias("c"))
    held = checkpointed(match.join(comp, ["dataset", "a"]).select("dataset", F.col("b").alias("g"), "c"), "held")
    up = ge.select("dataset", F.col("t").alias("g"), F.col("s").alias("above"))
    seen, front = held, held
    while not front.isEmpty():
        front = front.join(up, ["dataset", "g"]).select("dataset", F.col("above").alias("g"), "c").distinct()
        front = checkpointed(front.join(seen, ["dataset", "g", "c"], "left_anti"), "front")
        seen = seen.union(front)
    forks = pe.groupBy("dataset", F.col("s").alias("a")).count().where("count >= 2").select("dataset", "a")
    forked = forks.join(comp, ["dataset", "a"]).select("dataset", "c").distinct()
    true = ge.groupBy("dataset", "s").agg(F.min("t").alias("d1"), F.max("t").alias("d2"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    anchor = true.join(held.withColumnRenamed("g", "s"), ["dataset", "s"])
    above = true.join(up.withColumnRenamed("g", "s"), ["dataset", "s"]).join(held.withColumnRenamed("g", "above"), ["dataset", "above"]).drop("above")
    found = anchor.unionByName(above).join(forked, ["dataset", "c"], "left_semi")
    for child in ("d1", "d2"):
        found = found.join(seen.withColumnRenamed("g", child), ["dataset", child, "c"], "left_semi")
    found = checkpointed(found.select("dataset", "s").distinct(), "found")
    wrong = forks.join(match, ["dataset", "a"]).select("dataset", F.col("b").alias("s")).join(ge.select("dataset", "s"), ["dataset", "s"], "left_semi").join(found, ["dataset", "s"], "left_anti")
    return found, true, wrong


def division_counts(nodes: DataFrame, match: DataFrame, pe: DataFrame, ge: DataFrame) -> DataFrame:
    """(dataset, div_tp, div_fp, div_fn); a dataset of ``nodes`` without divisions has zeros."""
    found, true, wrong = division_sets(nodes, match, pe, ge)
    count = lambda rows, tp, fp, n: rows.select("dataset", F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(n).alias("n"))
    each = count(nodes, 0, 0, 0).distinct().union(count(found, 1, 0, 0)).union(count(wrong, 0, 1, 0)).union(count(true, 0, 0, 1))
    return each.groupBy("dataset").agg(F.sum("tp").alias("div_tp"), F.sum("fp").alias("div_fp"), (F.sum("n") - F.sum("tp")).alias("div_fn"))


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of all the scorer's figures for each movie, unrounded; a movie without truth or edges has zeros."""
    match, pe, ge = matched_graphs(spark, sf_dir)
    j, k = _predicted_edges(match, pe, ge), _true_edges(match, pe, ge)
    size = lambda rows, n: rows.groupBy("dataset").agg(F.count(F.lit(1)).alias(n))
    hit, both = F.col("hit"), F.col("has_s") & F.col("has_t")
    wrong = F.col("gs").isNotNull() & F.col("gt").isNotNull() & ~hit
    ej = j.groupBy("dataset").agg(F.count_if(hit).alias("edge_tp"), F.count_if(~hit & (F.col("ks") | F.col("kt"))).alias("edge_fp"), F.count_if(wrong).alias("wrong_association_edges"))
    ek = k.groupBy("dataset").agg(
        F.count_if(~F.col("found")).alias("edge_fn"), F.count_if("found").alias("edges_recovered"), F.count_if(both & ~F.col("found")).alias("edges_fragmented"), F.count_if(~both).alias("edges_lost_to_detection")
    )
    w = size(points(spark, sf_dir), "t_pred")
    for part in (size(ground_truth(spark, sf_dir), "n"), size(match, "k"), ej, ek, division_counts(points(spark, sf_dir), match, pe, ge)):
        w = w.join(part, "dataset", "left")
    w = w.fillna(0).withColumns({"t_true": F.col("n") * 2, "missed_gt_nodes": F.col("n") - F.col("k"), "spurious_pred_nodes": F.col("t_pred") - F.col("k")})
    e, d = ([F.col(f"{x}_{y}") for y in ("tp", "fp", "fn")] for x in ("edge", "div"))
    w = w.withColumns({"ejac": jaccard(*e), "djac": jaccard(*d), "weight": e[0] + e[1] + e[2]})
    return w.withColumn("adj", adjusted_jaccard(F.col("ejac"), F.col("t_pred"), F.col("t_true"), NODE_WEIGHT)).drop("n", "k")


@query("AG04_lineage_divisions", f"{DIVIDED} SELECT dataset, div_tp, div_fp, div_fn FROM div")
def lineage_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return division_counts(points(spark, sf_dir), *matched_graphs(spark, sf_dir))


@query("AG05_error_counts", f"{ROWS} SELECT dataset, {', '.join(ERRORS)} FROM rows_")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed and spurious nodes; true edges recovered, fragmented or lost to detection; links between the wrong true nodes."""
    return sample_rows(spark, sf_dir).select("dataset", *ERRORS)


@query(
    "AG06_missing_edge_categories",
    f"""{SCORED}, c AS (SELECT dataset, CASE WHEN NOT has_s AND NOT has_t THEN 'both_endpoints_missing' WHEN NOT has_s THEN 'source_endpoint_missing' WHEN NOT has_t THEN 'target_endpoint_missing'
        ELSE 'both_endpoints_present_wrong_or_missing_link' END AS category, count(*) AS n FROM k WHERE NOT found GROUP BY 1, 2),
    f AS (SELECT ge.dataset, count(*) - (SELECT count(*) FROM j WHERE hit AND j.dataset = ge.dataset) AS fn FROM ge GROUP BY ge.dataset)
    SELECT c.dataset, category, n, fn, sum(n) OVER (PARTITION BY c.dataset) = fn AS complete FROM c JOIN f ON f.dataset = c.dataset""",
)
def missing_edge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why true edges are missing, by their ends; ``complete``: the categories sum to the edges less the true positives."""
    match, pe, ge = matched_graphs(spark, sf_dir)
    s, t = F.col("has_s"), F.col("has_t")
    category = F.when(~s & ~t, "both_endpoints_missing").when(~s, "source_endpoint_missing").when(~t, "target_endpoint_missing").otherwise("both_endpoints_present_wrong_or_missing_link")
    c = _true_edges(match, pe, ge).where("not found").groupBy("dataset", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    tp = _predicted_edges(match, pe, ge).where("hit").groupBy("dataset").agg(F.count(F.lit(1)).alias("tp"))
    fn = ge.groupBy("dataset").agg(F.count(F.lit(1)).alias("all")).join(tp, "dataset", "left").select("dataset", (F.col("all") - F.coalesce("tp", F.lit(0))).alias("fn"))
    total = c.groupBy("dataset").agg(F.sum("n").alias("total"))
    return c.join(fn, "dataset").join(total, "dataset").select("dataset", "category", "n", "fn", (F.col("total") == F.col("fn")).alias("complete"))


_COUNTS = "edge_tp, edge_fp, edge_fn, t_pred, t_true, div_tp, div_fp, div_fn, weight, " + ", ".join(ERRORS)


@query("AG07_sample_metrics", f"{ROWS} SELECT dataset, round(ejac, 6) AS edge_jaccard, round(adj, 6) AS adjusted_edge_jaccard, round(djac, 6) AS div_jaccard, {_COUNTS} FROM rows_")
def sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sample_rows(spark, sf_dir)
    rounded = [F.round(c, 6).alias(n) for c, n in (("ejac", "edge_jaccard"), ("adj", "adjusted_edge_jaccard"), ("djac", "div_jaccard"))]
    return r.select("dataset", *rounded, *_COUNTS.split(", "))


_SUMS = ("div_tp", "div_fp", "div_fn", *ERRORS)


@query(
    "AG08_official_score",
    f"""{ROWS}, s AS (SELECT sum(adj * weight) / CASE WHEN sum(weight) = 0 THEN 1 ELSE sum(weight) END AS adj, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _SUMS)} FROM rows_), q AS (SELECT *, {_JACCARD.format('div')} AS djac FROM s)
    SELECT round(adj, 6) AS adjusted_edge_jaccard, round(djac, 6) AS division_jaccard, round(adj + {DIVISION_WEIGHT} * djac, 6) AS proxy_score, {', '.join(_SUMS)} FROM q""",
)
def official_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge score weighted by edges, plus a tenth of the Jaccard of the divisions of all movies together."""
    weight = F.sum("weight")
    s = sample_rows(spark, sf_dir).agg((F.sum(F.col("adj") * F.col("weight")) / F.when(weight == 0, 1).otherwise(weight)).alias("adj"), *(F.sum(c).alias(c) for c in _SUMS))
    s = s.withColumn("djac", jaccard(F.col("div_tp"), F.col("div_fp"), F.col("div_fn")))
    return s.select(F.round("adj", 6).alias("adjusted_edge_jaccard"), F.round("djac", 6).alias("division_jaccard"), F.round(F.col("adj") + DIVISION_WEIGHT * F.col("djac"), 6).alias("proxy_score"), *_SUMS)


@query(
    "AG37_division_outcomes",
    f"""{DIVIDED}, fa AS (SELECT DISTINCT an.dataset, an.s FROM (SELECT dv.dataset, dv.s, dv.s AS g FROM dv UNION SELECT dv.dataset, dv.s, ge.s FROM dv JOIN ge ON ge.dataset = dv.dataset AND ge.t = dv.s) an JOIN m ON m.dataset = an.dataset AND m.b = an.g
        JOIN pf ON pf.dataset = an.dataset AND pf.s = m.a), aa AS (SELECT DISTINCT dataset, s FROM an), mb AS (SELECT dataset, b FROM m)
    SELECT dv.dataset, CASE WHEN ok.s IS NOT NULL THEN 'tp' WHEN aa.s IS NULL OR x.b IS NULL OR y.b IS NULL THEN 'detection_miss' WHEN fa.s IS NULL THEN 'no_fork' ELSE 'wrong_daughters' END AS outcome, count(*) AS n
    FROM dv LEFT JOIN ok USING (dataset, s) LEFT JOIN aa USING (dataset, s) LEFT JOIN fa USING (dataset, s) LEFT JOIN mb x ON x.dataset = dv.dataset AND x.b = dv.d1 LEFT JOIN mb y ON y.dataset = dv.dataset AND y.b = dv.d2 GROUP BY 1, 2""",
)
def division_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True divisions that are found, whose nodes were missed, that do not fork, or that fork elsewhere."""
    match, pe, ge = matched_graphs(spark, sf_dir)
    found, true, _ = division_sets(points(spark, sf_dir), match, pe, ge)
    forks = pe.groupBy("dataset", F.col("s").alias("a")).count().where("count >= 2")
    matched = match.select("dataset", F.col("b").alias("g"))
    anchors = true.select("dataset", "s", F.col("s").alias("g")).union(true.select("dataset", "s").join(ge.select("dataset", F.col("t").alias("s"), F.col("s").alias("g")), ["dataset", "s"]).select("dataset", "s", "g"))
    forked = anchors.join(match.join(forks, ["dataset", "a"], "left_semi").select("dataset", F.col("b").alias("g")), ["dataset", "g"], "left_semi")
    told = true
    for rows, name in ((found, "found"), (anchors.join(matched, ["dataset", "g"], "left_semi"), "anchored"), (forked, "forked")):
        told = told.join(rows.select("dataset", "s").distinct().withColumn(name, F.lit(True)), ["dataset", "s"], "left")
    for child in ("d1", "d2"):
        told = told.join(matched.withColumnRenamed("g", child).withColumn(f"has_{child}", F.lit(True)), ["dataset", child], "left")
    told = told.fillna(False, ["found", "anchored", "forked", "has_d1", "has_d2"])
    outcome = F.when(F.col("found"), "tp").when(~(F.col("anchored") & F.col("has_d1") & F.col("has_d2")), "detection_miss").when(~F.col("forked"), "no_fork").otherwise("wrong_daughters")
    return told.groupBy("dataset", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "GR05_long_or_dividing_components",
    f"""{DIVIDED} SELECT comp.dataset, comp.c AS component, count(*) AS size, count(pf.s) > 0 AS has_division FROM comp LEFT JOIN pf ON pf.dataset = comp.dataset AND pf.s = comp.node_id
    GROUP BY comp.dataset, comp.c HAVING count(*) >= 6 OR count(pf.s) > 0""",
)
def long_or_dividing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of six nodes or more, and shorter ones that divide."""
    e = checkpointed(lineages(points(spark, sf_dir), PREDICTED_UM), "predicted")
    forks = e.groupBy("dataset", F.col("s").alias("node_id")).count().where("count >= 2").select("dataset", "node_id", F.lit(True).alias("forks"))
    c = graph.components(e.toDF("dataset", "source_id", "target_id")).join(forks, ["dataset", "node_id"], "left")
    sized = c.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.bool_or("forks"), F.lit(False)).alias("has_division"))
    return sized.where("size >= 6 or has_division")


@query("SNK03_metric_files", f"{ROWS} SELECT 'per_dataset' AS file, dataset, weight AS weight, round(adj, 6) AS adjusted FROM rows_ UNION ALL SELECT 'summary', 'all', sum(weight)::BIGINT, round(sum(adj * weight) / CASE WHEN sum(weight) = 0 THEN 1 ELSE sum(weight) END, 6) FROM rows_")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV with a row for each movie and one with the summary, read back with their headers checked."""
    where = shared_path(spark, "metrics")
    rows = checkpointed(sample_rows(spark, sf_dir), "rows")
    weight = F.sum("weight")
    mean = F.sum(F.col("adj") * F.col("weight")) / F.when(weight == 0, 1).otherwise(weight)
    rows.select("dataset", "weight", F.round("adj", 6).alias("adjusted")).write.csv(f"{where}/per_dataset", header=True)
    rows.agg(F.lit("all").alias("dataset"), weight.alias("weight"), F.round(mean, 6).alias("adjusted")).write.csv(f"{where}/summary", header=True)
    read = lambda name: spark.read.csv(f"{where}/{name}", header=True, schema="dataset string, weight long, adjusted double", enforceSchema=False).select(F.lit(name).alias("file"), "*")
    return read("per_dataset").union(read("summary"))


#: Distance in um within which an unmatched source may be the true parent.
IDENTITY_UM = 3.0


@query(
    "UD15_parent_labels",
    f"""{SCORED}, kids AS (SELECT dataset, s, count(*) AS n FROM ge GROUP BY dataset, s), lab AS (SELECT mt.dataset, mt.a AS target_id, ms.a AS source_id, ge.s AS parent, CASE WHEN kids.n = 2 THEN 2.0 ELSE 1.0 END AS weight
        FROM ge JOIN m mt ON mt.dataset = ge.dataset AND mt.b = ge.t JOIN m ms ON ms.dataset = ge.dataset AND ms.b = ge.s JOIN kids ON kids.dataset = ge.dataset AND kids.s = ge.s),
    {pairs_sql(IDENTITY_UM, 0, 'gt', 'pts', 'amb')}, mask AS (SELECT amb.dataset, amb.a AS parent, count(*) AS masked FROM amb WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.dataset = amb.dataset AND m.a = amb.b) GROUP BY 1, 2),
    fr AS (SELECT dataset, t, count(*) AS n FROM pts GROUP BY dataset, t)
    SELECT pts.dataset, pts.node_id AS target_id, coalesce(lab.source_id, -1) AS source_id, coalesce(lab.weight, 0)::DOUBLE AS weight, CASE WHEN lab.source_id IS NULL THEN 0 ELSE coalesce(mask.masked, 0) END AS masked,
        CASE WHEN lab.source_id IS NULL THEN 0 ELSE fr.n - coalesce(mask.masked, 0) END AS allowed
    FROM pts LEFT JOIN lab ON lab.dataset = pts.dataset AND lab.target_id = pts.node_id LEFT JOIN mask ON mask.dataset = lab.dataset AND mask.parent = lab.parent LEFT JOIN fr ON fr.dataset = pts.dataset AND fr.t = pts.t - 1""",
)
def parent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's known parent, -1 where truth says nothing, and how many sources of the frame before may serve as negatives.

    Sources without a match that lie near the true parent may be that parent: they are masked, not negatives.
    """
    match, _, ge = matched_graphs(spark, sf_dir)
    p, g = points(spark, sf_dir), ground_truth(spark, sf_dir)
    side = lambda k, v: match.select("dataset", F.col("b").alias(k), F.col("a").alias(v))
    kids = ge.groupBy("dataset", "s").agg(F.when(F.count(F.lit(1)) == 2, 2.0).otherwise(1.0).alias("weight"))
    lab = ge.join(side("t", "target_id"), ["dataset", "t"]).join(side("s", "source_id"), ["dataset", "s"]).join(kids, ["dataset", "s"]).withColumnRenamed("s", "parent").drop("t")
    near = spatial.radius_join(g, p, IDENTITY_UM).select("dataset", F.col("a_node_id").alias("parent"), F.col("b_node_id").alias("a"))
    mask = near.join(match, ["dataset", "a"], "left_anti").groupBy("dataset", "parent").agg(F.count(F.lit(1)).alias("masked"))
    frame = p.groupBy("dataset", (F.col("t") + 1).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    rows = p.select("dataset", F.col("node_id").alias("target_id"), "t").join(lab, ["dataset", "target_id"], "left").join(mask, ["dataset", "parent"], "left").join(frame, ["dataset", "t"], "left")
    known, masked = F.col("source_id").isNotNull(), F.coalesce("masked", F.lit(0))
    zero = F.lit(0).cast("long")
    return rows.select(
        "dataset", "target_id", F.coalesce("source_id", F.lit(-1).cast("long")).alias("source_id"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.when(known, masked).otherwise(zero).alias("masked"), F.when(known, F.col("n") - masked).otherwise(zero).alias("allowed"),
    )
