"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean_probability, dot, safe_cosine, um_distance, voxel_int
from ..operators import spatial
from ..sources import candidate_edges, detections, points, table
from .base import CAND, DET, DIST, PTS, pairs_sql, query, sql_query


@query("PRJ01_um_distance", f"WITH {PTS} SELECT a.node_id AS a, b.node_id AS b, round({DIST.format(a='a', b='b')}, 6) AS d FROM pts a JOIN pts b ON b.node_id = a.node_id + 5")
def um_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    a = p.select(F.col("node_id").alias("a"), *(F.col(c).alias("a_" + c) for c in "zyx"))
    b = p.select((F.col("node_id") - 5).alias("a"), F.col("node_id").alias("b"), *(F.col(c).alias("b_" + c) for c in "zyx"))
    return a.join(b, "a").select("a", "b", F.round(um_distance("a_", "b_"), 6).alias("d"))


@query("PRJ02_rescale", f"WITH {PTS} SELECT node_id, round(z * 1.625, 6) AS z_um, round(y * 0.40625, 6) AS y_um, round(x * 4, 6) AS x_full FROM pts")
def rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("node_id", F.round(F.col("z") * 1.625, 6).alias("z_um"), F.round(F.col("y") * 0.40625, 6).alias("y_um"), F.round(F.col("x") * 4, 6).alias("x_full"))


@query("PRJ03_clamped_half_even", f"WITH {PTS} SELECT node_id, greatest(0, round_even(z * 2 / 2, 0)::INTEGER) AS z, greatest(0, round_even(y, 0)::INTEGER) AS y FROM pts")
def clamped_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("node_id", voxel_int(F.col("z")).alias("z"), voxel_int(F.col("y")).alias("y"))


@query("PRJ04_clean_probability", """SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN 0 WHEN value / 40 BETWEEN 0 AND 1 THEN value / 40 ELSE 1 / (1 + exp(-greatest(-20, least(20, value / 40)))) END, 6) AS p FROM events""")
def clean_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 20 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 40)
    return table(spark, sf_dir, "events").select("event_id", F.round(clean_probability(raw), 6).alias("p"))


@query("PRJ05_edge_sort_key", f"WITH {CAND} SELECT dataset, target_id, arg_max(source_id, {{'p': edge_prob, 'd': -distance_um, 's': source_id}}) AS best FROM cand GROUP BY dataset, target_id")
def edge_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(F.coalesce("edge_prob", F.lit(0.0)).alias("p"), (-F.col("distance_um")).alias("d"), "source_id")
    return candidate_edges(spark, sf_dir).groupBy("dataset", "target_id").agg(F.max_by("source_id", key).alias("best"))


@query("PRJ06_edge_validity", f"WITH {CAND} SELECT dataset, count(*) AS n, count_if(distance_um <= 3)::BIGINT AS kept, count_if(distance_um > 3)::BIGINT AS dropped FROM cand GROUP BY dataset")
def edge_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends, in consecutive frames and within the gate, with counts of the rest."""
    e, p = candidate_edges(spark, sf_dir), points(spark, sf_dir)
    e = e.join(p.select("dataset", F.col("node_id").alias("source_id"), F.col("t").alias("ts")), ["dataset", "source_id"]).join(p.select("dataset", F.col("node_id").alias("target_id"), F.col("t").alias("tt")), ["dataset", "target_id"])
    ok = (F.col("tt") == F.col("ts") + 1) & (F.col("distance_um") <= 3)
    return e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("PRJ07_threshold_filters", f"WITH {DET} SELECT event_id, score FROM det WHERE score >= 0.7 OR event_id % 1000 = 0")
def threshold_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("score >= 0.7 or event_id % 1000 = 0").select("event_id", "score")


sql_query("PRJ08_mask_composition", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity < 10 AND (l_discount > 0.05 OR l_tax < 0.02) AND NOT l_returnflag = 'N'")


@query("PRJ09_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v")), "a")
    norm = lambda c: F.sqrt(dot(c, c))
    return pairs.select("a", "b", F.round(safe_cosine(dot("u", "v"), norm("u"), norm("v")), 5).alias("cosine"))


sql_query("PRJ10_symmetry_ratio", "SELECT l_orderkey, l_linenumber, round(abs(l_discount - l_tax) / greatest((l_discount + l_tax) / 2, 1e-6), 6) AS ratio FROM {lineitem}")
sql_query("PRJ11_interpolation", """SELECT user_id, d, k, round(v + (nv - v) * k / (nd - d), 6) AS v FROM (SELECT user_id, d, v, nd, nv, explode(sequence(1, nd - d - 1)) AS k FROM (SELECT user_id, d, v, lead(d) OVER w AS nd, lead(v) OVER w AS nv FROM
    (SELECT user_id, datediff(ts, DATE '2024-01-01') AS d, avg(value) AS v FROM {events} GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY d)) WHERE nd BETWEEN d + 2 AND d + 4)""",
    """WITH t AS (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS d, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT user_id, d, v, lead(d) OVER w AS nd, lead(v) OVER w AS nv FROM t WINDOW w AS (PARTITION BY user_id ORDER BY d))
    SELECT user_id, d, k::INTEGER AS k, round(v + (nv - v) * k / (nd - d), 6) AS v FROM n, unnest(range(1, nd - d)) AS u(k) WHERE nd BETWEEN d + 2 AND d + 4""")
sql_query("PRJ12_extrapolation", """SELECT user_id, d, round(2 * v - pv, 6) AS next FROM (SELECT user_id, d, v, lag(v) OVER (PARTITION BY user_id ORDER BY d) AS pv FROM (SELECT user_id, datediff(ts, DATE '2024-01-01') AS d, avg(value) AS v FROM {events} GROUP BY 1, 2)) WHERE pv IS NOT NULL""",
    """SELECT user_id, d, round(2 * v - pv, 6) AS next FROM (SELECT user_id, d, v, lag(v) OVER (PARTITION BY user_id ORDER BY d) AS pv FROM (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS d, avg(value) AS v FROM events GROUP BY 1, 2)) WHERE pv IS NOT NULL""")
sql_query("PRJ13_standardise_clip", """SELECT o.o_orderkey, round(greatest(-10, least(10, (o.o_totalprice - m.mu) / greatest(m.sd, 1e-6))), 6) AS z FROM {orders} o CROSS JOIN (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM {orders} WHERE o_orderkey % 4 <> 0) m""")


@query("PRJ14_softmax", f"WITH {CAND} SELECT dataset, source_id, target_id, round(exp(edge_prob - max(edge_prob) OVER w) / sum(exp(edge_prob)) OVER w * exp(max(edge_prob) OVER w), 6) AS p FROM cand WINDOW w AS (PARTITION BY dataset, target_id)")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("dataset", "target_id")
    e = candidate_edges(spark, sf_dir).withColumn("x", F.exp(F.col("edge_prob") - F.max("edge_prob").over(w)))
    return e.select("dataset", "source_id", "target_id", F.round(F.col("x") / F.sum("x").over(w), 6).alias("p"))


@query("PRJ15_logit_calibration", f"WITH {CAND}, s AS (SELECT *, ln(edge_prob / (1 - edge_prob)) AS l FROM cand WHERE edge_prob < 1) SELECT dataset, source_id, target_id, round((l - avg(l) OVER w) * greatest(0.5, least(2, 1 / nullif(stddev_pop(l) OVER w, 0))), 4) AS l FROM s WINDOW w AS (PARTITION BY dataset)")
def logit_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("dataset")
    e = candidate_edges(spark, sf_dir).where("edge_prob < 1").withColumn("l", F.log(F.col("edge_prob") / (1 - F.col("edge_prob"))))
    m = e.groupBy("dataset").agg(F.avg("l").alias("mu"), F.stddev_pop("l").alias("sd"))
    ratio = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 / F.expr("nullif(sd, 0)")))
    return e.join(m, "dataset").select("dataset", "source_id", "target_id", F.round((F.col("l") - F.col("mu")) * ratio, 4).alias("l"))


@query(
    "PRJ16_harmonic_fusion",
    f"""WITH {CAND}, f AS (SELECT dataset, source_id, target_id, edge_prob / sum(edge_prob) OVER (PARTITION BY dataset, source_id) AS pf, edge_prob / sum(edge_prob) OVER (PARTITION BY dataset, target_id) AS pr FROM cand),
    h AS (SELECT *, 1 / (0.4 / pf + 0.6 / pr) AS h FROM f) SELECT dataset, source_id, target_id, round(h / sum(h) OVER (PARTITION BY dataset, target_id), 6) AS p FROM h""",
)
def harmonic_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted harmonic mean of forward and reverse shares, made to sum to one for each target."""
    share = lambda side: F.col("edge_prob") / F.sum("edge_prob").over(Window.partitionBy("dataset", side))
    e = candidate_edges(spark, sf_dir).withColumns({"pf": share("source_id"), "pr": share("target_id")})
    e = e.withColumn("h", 1 / (0.4 / F.col("pf") + 0.6 / F.col("pr")))
    return e.select("dataset", "source_id", "target_id", F.round(F.col("h") / F.sum("h").over(Window.partitionBy("dataset", "target_id")), 6).alias("p"))


@query(
    "PRJ17_low_margin_blend",
    f"""WITH {CAND}, r AS (SELECT *, 1 - distance_um / 8 AS q, max(edge_prob) OVER w AS m, row_number() OVER (PARTITION BY dataset, target_id ORDER BY edge_prob DESC, source_id) AS k FROM cand WINDOW w AS (PARTITION BY dataset, target_id)),
    t AS (SELECT dataset, target_id, max(edge_prob) - max(CASE WHEN k = 2 THEN edge_prob END) AS margin, arg_max(source_id, {{'p': edge_prob, 's': -source_id}}) = arg_max(source_id, {{'q': q, 's': -source_id}}) AS agree FROM r GROUP BY 1, 2)
    SELECT r.dataset, r.source_id, r.target_id, round(edge_prob + CASE WHEN agree THEN 0.5 * greatest(0, least(1, (0.2 - coalesce(margin, 1)) / 0.2)) ELSE 0 END * (q - edge_prob), 6) AS p FROM r JOIN t USING (dataset, target_id)""",
)
def low_margin_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second opinion is blended in where the first is close and both name the same source."""
    order = Window.partitionBy("dataset", "target_id").orderBy(F.col("edge_prob").desc(), "source_id")
    r = candidate_edges(spark, sf_dir).withColumns({"q": 1 - F.col("distance_um") / 8, "k": F.row_number().over(order)})
    top = lambda c: F.max_by("source_id", F.struct(c, (-F.col("source_id")).alias("s")))
    t = r.groupBy("dataset", "target_id").agg((F.max("edge_prob") - F.max(F.when(F.col("k") == 2, F.col("edge_prob")))).alias("margin"), (top("edge_prob") == top("q")).alias("agree"))
    weight = F.when(F.col("agree"), 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.2 - F.coalesce("margin", F.lit(1.0))) / 0.2))).otherwise(0.0)
    return r.join(t, ["dataset", "target_id"]).select("dataset", "source_id", "target_id", F.round(F.col("edge_prob") + weight * (F.col("q") - F.col("edge_prob")), 6).alias("p"))


sql_query("PRJ18_blend_modes", """SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN 0.5 * o_totalprice + 0.5 * o_custkey ELSE sqrt(o_totalprice) END, 6) AS v FROM {orders}""")
sql_query("PRJ19_retention_guard", """SELECT l_suppkey, CASE WHEN count_if(l_discount > 0.01) / count(*) < 0.9 THEN 'primary' ELSE 'blended' END AS used FROM {lineitem} GROUP BY l_suppkey""")
sql_query("PRJ20_weighted_blends", """SELECT a.i AS step, round(avg((1 - a.i / 10) * l_discount + a.i / 10 * l_tax), 8) AS blend FROM {lineitem} CROSS JOIN (SELECT explode(sequence(0, 10)) AS i) a GROUP BY a.i""",
    """SELECT i::INTEGER AS step, round(avg((1 - i / 10) * l_discount + i / 10 * l_tax), 8) AS blend FROM lineitem, range(11) a(i) GROUP BY i""")
sql_query("PRJ21_quantile_normalise", """SELECT e.event_id, round(greatest(0, (e.value - m.lo) / nullif(m.hi - m.lo, 0)), 6) AS v FROM {events} e JOIN (SELECT event_type, percentile(value, 0.01) AS lo, percentile(value, 0.99) AS hi FROM {events} GROUP BY event_type) m ON m.event_type = e.event_type""",
    """SELECT e.event_id, round(greatest(0, (e.value - m.lo) / nullif(m.hi - m.lo, 0)), 6) AS v FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY event_type) m ON m.event_type = e.event_type""")
sql_query("PRJ22_bounded_shift", "SELECT l_orderkey, l_linenumber, round(2 * l_discount / (1 + sqrt(l_discount * l_discount + l_tax * l_tax)), 8) AS dx FROM {lineitem}")
sql_query("PRJ23_hash_folds", """SELECT doc_id, CAST(conv(substring(sha2(CAST(doc_id AS STRING), 256), 1, 8), 16, 10) AS BIGINT) % 5 AS fold, substring(sha2(CAST(doc_id AS STRING), 256), 1, 12) AS order_key FROM {documents}""",
    """SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold, substr(sha256(doc_id::VARCHAR), 1, 12) AS order_key FROM documents""")
sql_query("PRJ24_prefix_key", """SELECT substring_index(c_name, '#', 1) AS prefix, count(*) AS n FROM {customer} GROUP BY 1""", "SELECT split_part(c_name, '#', 1) AS prefix, count(*) AS n FROM customer GROUP BY 1")
sql_query("PRJ25_last_assignment_wins", r"""SELECT doc_id, max_by(v, struct(pos)) AS last_token FROM (SELECT doc_id, posexplode(regexp_extract_all(text, '(?:password=|token = ")([0-9a-f]+)', 1)) AS (pos, v) FROM {documents}) GROUP BY doc_id""",
    r"""SELECT doc_id, list_last(regexp_extract_all(text, '(?:password=|token = ")([0-9a-f]+)', 1)) AS last_token FROM documents WHERE len(regexp_extract_all(text, '(?:password=|token = ")([0-9a-f]+)', 1)) > 0""")
sql_query("PRJ26_strip_comments", r"""SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '')) AS n FROM {pages}""", r"""SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs'))::INTEGER AS n FROM pages""")
sql_query("PRJ27_keyword_category", """SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 'license' WHEN lower(text) LIKE '%password%' THEN 'secret' WHEN n_chars > 5000 THEN 'long' ELSE 'plain' END AS category FROM {documents}""")
sql_query("PRJ28_red_flags", r"""SELECT doc_id, greatest(CASE WHEN text RLIKE 'AKIA[0-9A-Z]{16}' THEN 2 ELSE 0 END, CASE WHEN text RLIKE 'password=' THEN 1 ELSE 0 END) AS severity FROM {documents}""",
    r"""SELECT doc_id, greatest(CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 2 ELSE 0 END, CASE WHEN regexp_matches(text, 'password=') THEN 1 ELSE 0 END) AS severity FROM documents""")
sql_query("PRJ29_safe_component", r"""SELECT page_id, btrim(regexp_replace(substring(url, 1, 100), '[^A-Za-z0-9._-]+', '-'), '-.') AS name FROM {pages}""", r"""SELECT page_id, trim(regexp_replace(substring(url, 1, 100), '[^A-Za-z0-9._-]+', '-', 'g'), '-.') AS name FROM pages""")
sql_query("PRJ30_content_digest", "SELECT doc_id, sha2(text, 256) AS digest FROM {documents}", "SELECT doc_id, sha256(text) AS digest FROM documents")
sql_query("PRJ31_recent_window", """SELECT e.event_id FROM {events} e CROSS JOIN (SELECT max(ts) AS last FROM {events}) m WHERE e.ts >= m.last - INTERVAL 24 HOURS""", "SELECT e.event_id FROM events e CROSS JOIN (SELECT max(ts) AS last FROM events) m WHERE e.ts >= m.last - INTERVAL 24 HOURS")
sql_query("PRJ32_peak_and_mean", """SELECT vec_id, round(aggregate(embedding, CAST(-9 AS DOUBLE), (a, x) -> greatest(a, CAST(x AS DOUBLE))), 5) AS peak, round(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE)) / size(embedding), 6) AS mean FROM {embeddings}""",
    "SELECT vec_id, round(list_max(embedding)::DOUBLE, 5) AS peak, round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")


@query(
    "PRJ33_weighted_centroid",
    f"""WITH {PTS}, w AS (SELECT *, (node_id % 10 + 1)::DOUBLE AS v FROM pts), b AS (SELECT dataset, t, quantile_cont(v, 0.2) AS base FROM w GROUP BY dataset, t)
    SELECT w.dataset, w.t, round(sum(greatest(v - base, 0) * z) / sum(greatest(v - base, 0)), 6) AS z, round(sum(greatest(v - base, 0) * y) / sum(greatest(v - base, 0)), 6) AS y FROM w JOIN b ON b.dataset = w.dataset AND b.t = w.t GROUP BY w.dataset, w.t""",
)
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("v", (F.col("node_id") % 10 + 1).cast("double"))
    p = p.join(p.groupBy("dataset", "t").agg(F.percentile("v", F.lit(0.2)).alias("base")), ["dataset", "t"])
    w = F.greatest(F.col("v") - F.col("base"), F.lit(0.0))
    mean = lambda c: F.round(F.sum(w * F.col(c)) / F.sum(w), 6).alias(c)
    return p.groupBy("dataset", "t").agg(mean("z"), mean("y"))


@query("PRJ34_local_maxima", f"WITH {PTS}, {pairs_sql(3.0, 0)} SELECT dataset, node_id FROM pts p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.dataset = p.dataset AND n.a = p.node_id AND n.b % 97 > n.a % 97)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that no neighbour within 3 um exceeds in score."""
    p = points(spark, sf_dir)
    beaten = spatial.radius_join(p, p, 3.0).where("b_node_id % 97 > a_node_id % 97").select("dataset", F.col("a_node_id").alias("node_id"))
    return p.select("dataset", "node_id").join(beaten, ["dataset", "node_id"], "left_anti")


sql_query("PRJ35_binning", "SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS band FROM {part}")
sql_query("PRJ36_typed_override", """SELECT c_custkey, coalesce(try_cast(nullif(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS STRING) ELSE '' END, '') AS DOUBLE), 0.5D) AS v FROM {customer}""",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 0.5 END AS v FROM customer")
sql_query("PRJ37_flag_or", "SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END, CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS flag FROM {lineitem}")

sql_query("F01_case_and_trim", "SELECT c_custkey, lower(c_mktsegment) AS a, btrim(c_name, 'C#') AS b FROM {customer}", "SELECT c_custkey, lower(c_mktsegment) AS a, trim(c_name, 'C#') AS b FROM customer")
sql_query("F02_split_prefix_suffix", "SELECT page_id, split(url, '/')[2] AS host, startswith(url, 'https') AS secure, regexp_replace(url, '\\\\.html$', '') AS stem FROM {pages}", "SELECT page_id, split_part(url, '/', 3) AS host, starts_with(url, 'https') AS secure, regexp_replace(url, '\\.html$', '') AS stem FROM pages")
sql_query("F03_replace_and_default", "SELECT p_partkey, replace(p_name, ' ', '-') AS a, coalesce(nullif(substring(p_brand, 1, 5), ''), '-') AS b, concat_ws('|', p_brand, p_type) AS c FROM {part}")
sql_query("F04_containment", "SELECT doc_id, contains(lower(text), 'license') AS a, contains(text, '@') AS b FROM {documents}")
sql_query("F05_regex", r"SELECT doc_id, size(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}', 0)) AS n, length(regexp_replace(text, '[0-9]', '')) AS m FROM {documents}", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))::INTEGER AS n, length(regexp_replace(text, '[0-9]', '', 'g'))::INTEGER AS m FROM documents")
sql_query("F06_formatting", "SELECT o_orderkey, format_string('%08d', o_custkey) AS a FROM {orders}", "SELECT o_orderkey, printf('%08d', o_custkey) AS a FROM orders")
sql_query("F07_digest", "SELECT c_custkey, sha2(c_name, 256) AS d, md5(c_name) AS m FROM {customer}", "SELECT c_custkey, sha256(c_name) AS d, md5(c_name) AS m FROM customer")
sql_query("F08_bytes_little_endian", """SELECT c_custkey, CAST(CAST(conv(concat(substring(h, 15, 2), substring(h, 13, 2), substring(h, 11, 2), substring(h, 9, 2), substring(h, 7, 2), substring(h, 5, 2), substring(h, 3, 2), substring(h, 1, 2)), 16, 10) AS DECIMAL(20, 0)) % 7 AS BIGINT) AS fold FROM (SELECT c_custkey, sha2(c_name, 256) AS h FROM {customer})""",
    """SELECT c_custkey, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % 7)::BIGINT AS fold FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer)""")
sql_query("F09_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, year(o_orderdate) AS y FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate)::INTEGER AS y FROM orders")
sql_query("F10_date_arithmetic", "SELECT o_orderkey, datediff(o_orderdate, DATE '1992-01-01') AS days, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS later FROM {orders}", "SELECT o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS days, (o_orderdate + INTERVAL 3 DAYS)::DATE AS later FROM orders")
sql_query("F11_fixed_offset", "SELECT event_id, date_format(ts + INTERVAL 9 HOURS, 'yyyy-MM-dd HH') AS h FROM {events}", "SELECT event_id, strftime(ts + INTERVAL 9 HOURS, '%Y-%m-%d %H') AS h FROM events")
sql_query("F12_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(exp(-p_size / 10), 6) AS b, round(ln(p_retailprice), 6) AS c, abs(p_size - 25) AS d FROM {part}")
sql_query("F13_clip", "SELECT c_custkey, greatest(0, least(5000, c_acctbal)) AS v FROM {customer}")
sql_query("F14_half_even", "SELECT l_orderkey, l_linenumber, CAST(rint(l_quantity / 2) AS BIGINT) AS a, CAST(floor(l_quantity / 7) AS BIGINT) AS b, CAST(l_quantity AS BIGINT) % 3 AS c FROM {lineitem}", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::BIGINT AS a, floor(l_quantity / 7)::BIGINT AS b, l_quantity::BIGINT % 3 AS c FROM lineitem")
sql_query("F15_finiteness", "SELECT c_custkey, isnan(c_acctbal) AS a, c_acctbal IS NOT NULL AS b, abs(c_acctbal - rint(c_acctbal)) <= 0.1 AS c FROM {customer}", "SELECT c_custkey, isnan(c_acctbal) AS a, c_acctbal IS NOT NULL AS b, abs(c_acctbal - round_even(c_acctbal, 0)) <= 0.1 AS c FROM customer")
sql_query("F16_array_gather", "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS a, size(concat(embedding, array(1F))) AS n FROM {embeddings}", "SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS a, len(list_concat(embedding, [1.0::FLOAT]))::INTEGER AS n FROM embeddings")
sql_query("F17_array_norm", "SELECT vec_id, round(sqrt(aggregate(zip_with(embedding, embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (a, v) -> a + v)), 5) AS norm FROM {embeddings}", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
sql_query("F18_array_argsort", "SELECT vec_id, pos AS top FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS k FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM {embeddings})) WHERE k <= 2", "SELECT vec_id, (i - 1)::INTEGER AS top FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] DESC, i) AS k FROM embeddings, range(1, 65) r(i)) WHERE k <= 2")
sql_query("F19_array_argmax_unravel", "SELECT vec_id, CAST(max_by(pos, struct(v, -pos)) DIV 8 AS INT) AS r, max_by(pos, struct(v, -pos)) % 8 AS c FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM {embeddings}) GROUP BY vec_id", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER // 8 AS r, ((list_position(embedding, list_max(embedding)) - 1) % 8)::INTEGER AS c FROM embeddings")
sql_query("F20_combinations", "SELECT a.r_name AS a, b.r_name AS b FROM {region} a JOIN {region} b ON a.r_regionkey < b.r_regionkey")
sql_query("F21_map_get_and_merge", "SELECT user_id, coalesce(element_at(map_from_entries(collect_list(struct(event_type, n))), 'click'), 0) AS clicks FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id", "SELECT user_id, count_if(event_type = 'click')::BIGINT AS clicks FROM events GROUP BY user_id")
sql_query("F22_json_parse", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
sql_query("F23_json_dump", "SELECT c_custkey, to_json(named_struct('k', c_custkey, 's', c_mktsegment)) AS j FROM {customer}", "SELECT c_custkey, '{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS j FROM customer")
sql_query("F24_rule_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'a' WHEN o_orderpriority LIKE '1%' THEN 'b' ELSE coalesce(nullif(o_orderstatus, 'O'), 'c') END AS rule FROM {orders}")
