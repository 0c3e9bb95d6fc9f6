"""How well choices do: the best candidate of each parent, thresholds for swapping to the second choice, residuals before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SCALE
from ..sources import candidate_edges, points, table
from .base import CAND, query
from .graphs import LINKS, links

THRESHOLDS = (0.2, 0.3, 0.5, 0.8)


@query(
    "AG24_best_of_each_parent",
    f"""WITH {LINKS}, c AS (SELECT cand.*, l.source_id IS NOT NULL AS y FROM (WITH {CAND} SELECT * FROM cand) cand LEFT JOIN link l USING (dataset, source_id, target_id)),
    b AS (SELECT dataset, source_id, max(edge_prob) AS p, arg_min(y, {{'p': -edge_prob, 't': target_id}}) AS y, bool_or(y) AS has FROM c GROUP BY dataset, source_id)
    SELECT thr, count(*) FILTER (WHERE p >= thr AND y)::BIGINT AS tp, count(*) FILTER (WHERE p >= thr AND NOT y)::BIGINT AS fp, (count(*) FILTER (WHERE has) - count(*) FILTER (WHERE p >= thr AND y))::BIGINT AS fn
    FROM b, (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS thr) GROUP BY thr""",
)
def best_of_each_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each parent, its best: hits, false ones, and parents whose true child is not taken."""
    true = links(spark, sf_dir).withColumn("y", F.lit(True))
    c = candidate_edges(spark, sf_dir).join(true, ["dataset", "source_id", "target_id"], "left").fillna(False, ["y"])
    best = c.groupBy("dataset", "source_id").agg(F.min(F.struct((-F.col("edge_prob")).alias("p"), "target_id", "y")).alias("m"), F.bool_or("y").alias("has"))
    rows = best.select((-F.col("m.p")).alias("p"), F.col("m.y").alias("y"), "has", F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("thr"))
    taken = F.col("p") >= F.col("thr")
    return rows.groupBy("thr").agg(F.count_if(taken & F.col("y")).alias("tp"), F.count_if(taken & ~F.col("y")).alias("fp"), (F.count_if("has") - F.count_if(taken & F.col("y"))).alias("fn"))


@query(
    "AG27_swap_threshold",
    """WITH r AS (SELECT (o_orderkey % 1000) / 1000 AS p, o_orderstatus = 'F' AS base, o_orderpriority <> '1-URGENT' AS top2 FROM orders),
    g AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE NOT base AND top2) AS f, count(*) FILTER (WHERE base AND NOT top2) AS b, count(*) FILTER (WHERE NOT base AND NOT top2) AS w FROM r GROUP BY p),
    c AS (SELECT p, sum(n) OVER v AS k, sum(f) OVER v AS fixes, sum(b) OVER v AS breaks, sum(w) OVER v AS wrong FROM g WINDOW v AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT * FROM c WHERE fixes > breaks AND fixes >= 2 * breaks ORDER BY fixes - breaks DESC, fixes DESC, breaks, wrong, k LIMIT 1)
    SELECT max(round(p - 1e-7, 9)) AS threshold, max(fixes - breaks)::BIGINT AS net, max(fixes)::BIGINT AS fixes, max(breaks)::BIGINT AS breaks, max(k)::BIGINT AS swapped FROM q""",
)
def swap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score from which swapping to the second choice fixes most: equal scores together, more fixes than breaks, at least two for one.

    One row; nulls where no threshold qualifies. Running sums meet once for each distinct score, at most 1,000.
    """
    o = table(spark, sf_dir, "orders")
    base, top2 = F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "1-URGENT"
    g = o.groupBy(((F.col("o_orderkey") % 1000) / 1000).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~base & top2).alias("f"), F.count_if(base & ~top2).alias("b"), F.count_if(~base & ~top2).alias("w"))
    run = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    c = g.select("p", *(F.sum(a).over(run).alias(n) for a, n in (("n", "k"), ("f", "fixes"), ("b", "breaks"), ("w", "wrong")))).where("fixes > breaks and fixes >= 2 * breaks")
    rank = F.struct((F.col("fixes") - F.col("breaks")).alias("net"), F.col("fixes"), (-F.col("breaks")).alias("lost"), (-F.col("wrong")).alias("w"), (-F.col("k")).alias("k"))
    best = c.agg(F.max(F.struct(rank.alias("rank"), "p")).alias("m"))
    return best.select(F.round(F.col("m.p") - 1e-7, 9).alias("threshold"), F.col("m.rank.net").alias("net"), F.col("m.rank.fixes").alias("fixes"), (-F.col("m.rank.lost")).alias("breaks"), (-F.col("m.rank.k")).alias("swapped"))


_STEPS = ", ".join(f"(q.{c} - p.{c}) * {s} AS {c}" for c, s in zip("zyx", SCALE, strict=True))


@query(
    "AG35_residuals_before_after",
    f"""WITH {LINKS}, s AS (SELECT l.dataset, p.t, {_STEPS} FROM link l JOIN pts p ON p.dataset = l.dataset AND p.node_id = l.source_id JOIN pts q ON q.dataset = l.dataset AND q.node_id = l.target_id),
    f AS (SELECT dataset, t, median(z) AS z, median(y) AS y, median(x) AS x FROM s GROUP BY dataset, t),
    r AS (SELECT s.dataset, sqrt(s.z*s.z + s.y*s.y + s.x*s.x) AS b, sqrt((s.z-f.z)*(s.z-f.z) + (s.y-f.y)*(s.y-f.y) + (s.x-f.x)*(s.x-f.x)) AS a, sqrt(f.z*f.z + f.y*f.y + f.x*f.x) AS m FROM s JOIN f ON f.dataset = s.dataset AND f.t = s.t)
    SELECT dataset, count(*) AS n, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after, round(median(b), 6) AS median_before, round(median(a), 6) AS median_after, round(avg(a) / avg(b) - 1, 6) AS rel_change,
        round(avg(CASE WHEN a < b THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS frac_closer, round(avg(m), 6) AS mean_shift FROM r GROUP BY dataset""",
)
def residuals_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of link displacements before and after each frame's median displacement is taken off."""
    p = points(spark, sf_dir)
    side = lambda n, s: p.select("dataset", F.col("node_id").alias(n), F.col("t").alias(s + "t"), *(F.col(c).alias(s + c) for c in "zyx"))
    s = links(spark, sf_dir).join(side("source_id", "p"), ["dataset", "source_id"]).join(side("target_id", "q"), ["dataset", "target_id"])
    s = s.select("dataset", F.col("pt").alias("t"), *(((F.col("q" + c) - F.col("p" + c)) * k).alias(c) for c, k in zip("zyx", SCALE, strict=True)))
    f = s.groupBy("dataset", "t").agg(*(F.percentile(c, F.lit(0.5)).alias("f" + c) for c in "zyx"))
    norm = lambda of: F.sqrt(of("z") * of("z") + of("y") * of("y") + of("x") * of("x"))
    r = s.join(f, ["dataset", "t"]).select("dataset", norm(F.col).alias("b"), norm(lambda c: F.col(c) - F.col("f" + c)).alias("a"), norm(lambda c: F.col("f" + c)).alias("m"))
    six = lambda c, n: F.round(c, 6).alias(n)
    half = F.lit(0.5)
    return r.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), six(F.avg("b"), "mean_before"), six(F.avg("a"), "mean_after"), six(F.percentile("b", half), "median_before"), six(F.percentile("a", half), "median_after"),
        six(F.avg("a") / F.avg("b") - 1, "rel_change"), six(F.avg((F.col("a") < F.col("b")).cast("double")), "frac_closer"), six(F.avg("m"), "mean_shift"),
    )


#: Features of each fit, and the columns they are.
FITS = (("size", None), ("key", None), ("name", None), ("size", "key"), ("size", "name"), ("key", "name"))


def _fit_sql(a: str, b: str | None) -> str:
    if b is None:
        return f"SELECT '{a}' AS features, y - s_{a}y / s_{a}{a} * {a} AS e, 1.0 / n + {a} * {a} / s_{a}{a} AS h FROM d, s"
    det = f"(s_{a}{a} * s_{b}{b} - s_{a}{b} * s_{a}{b})"
    return f"""SELECT '{a}+{b}' AS features, y - (s_{b}{b} * s_{a}y - s_{a}{b} * s_{b}y) / {det} * {a} - (s_{a}{a} * s_{b}y - s_{a}{b} * s_{a}y) / {det} * {b} AS e,
        1.0 / n + (s_{b}{b} * {a} * {a} - 2 * s_{a}{b} * {a} * {b} + s_{a}{a} * {b} * {b}) / {det} AS h FROM d, s"""


_PRODUCTS = ("size", "size"), ("key", "key"), ("name", "name"), ("size", "key"), ("size", "name"), ("key", "name"), ("size", "y"), ("key", "y"), ("name", "y")


@query(
    "AG28_leave_one_out_fits",
    f"""WITH p AS (SELECT p_retailprice AS y, p_size::DOUBLE AS size, p_partkey::DOUBLE AS key, length(p_name)::DOUBLE AS name FROM part), m AS (SELECT avg(y) AS my, avg(size) AS ms, avg(key) AS mk, avg(name) AS mn FROM p),
    d AS (SELECT y - my AS y, size - ms AS size, key - mk AS key, name - mn AS name FROM p, m), s AS (SELECT count(*) AS n, {', '.join(f'sum({a} * {b}) AS s_{a}{b}' for a, b in _PRODUCTS)} FROM d),
    r AS ({' UNION ALL '.join(_fit_sql(*f) for f in FITS)}) SELECT features, count(*) AS n, round(sqrt(avg(e / (1 - h) * (e / (1 - h)))), 4) AS rms FROM r GROUP BY features""",
)
def leave_one_out_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of leave-one-out residuals of linear fits on one and two features.

    A left-out residual is the residual over one less its leverage, so two passes of sums
    replace a fit for each row. A fit whose features are constant or collinear has a null.
    """
    t = table(spark, sf_dir, "part")
    p = t.select(F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("size"), F.col("p_partkey").cast("double").alias("key"), F.length("p_name").cast("double").alias("name"))
    names = ("y", "size", "key", "name")
    # one row of means and one of sums
    d = p.join(F.broadcast(p.agg(*(F.avg(c).alias("m_" + c) for c in names)))).select(*((F.col(c) - F.col("m_" + c)).alias(c) for c in names))
    d = d.join(F.broadcast(d.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in _PRODUCTS))))
    s = lambda a, b: F.col(f"s_{a}{b}")
    fits = []
    for a, b in FITS:
        x, z = F.col(a), F.col(b or a)
        if b is None:
            det = F.nullif(s(a, a), F.lit(0.0))
            e, h = F.col("y") - s(a, "y") / det * x, x * x / det
        else:
            det = F.nullif(s(a, a) * s(b, b) - s(a, b) * s(a, b), F.lit(0.0))
            e = F.col("y") - (s(b, b) * s(a, "y") - s(a, b) * s(b, "y")) / det * x - (s(a, a) * s(b, "y") - s(a, b) * s(a, "y")) / det * z
            h = (s(b, b) * x * x - 2 * s(a, b) * x * z + s(a, a) * z * z) / det
        fits.append(F.struct(F.lit(f"{a}+{b}" if b else a).alias("features"), (e / (1 - h - 1.0 / F.col("n"))).alias("r")))
    r = d.select(F.explode(F.array(*fits)).alias("f")).select("f.features", "f.r")
    return r.groupBy("features").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("r") * F.col("r"))), 4).alias("rms"))
