"""Sources, sinks and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpointed, shared_path
from ..schema import SUBMISSION_COLUMNS
from ..sources import candidate_edges, files, points, table
from .base import CAND, ORACLE_SQL, PTS, query, sql_query

sql_query("SRC02_json_metadata", "SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM {events}", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")


@query("SRC03_graph_scan", f"WITH {CAND} SELECT c.dataset, c.source_id, c.target_id, c.distance_um FROM cand c")
def graph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges written as Parquet and read back."""
    return checkpointed(candidate_edges(spark, sf_dir), "graph").select("dataset", "source_id", "target_id", "distance_um")


@query("SRC04_point_scan", f"WITH {PTS} SELECT t, z, y, x FROM pts WHERE dataset = 'd0'")
def point_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("dataset = 'd0'").select("t", "z", "y", "x")


sql_query("SRC05_json_key_lookup", "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM {events} GROUP BY 1", "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")


@query("SRC06_csv_exact_header", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def csv_exact_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    where = shared_path(spark)
    c.write.csv(where, header=True)
    return files.read_csv_exact(spark, where, c.schema)


sql_query("SRC07_parquet_pushdown", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= DATE '1995-01-01' AND o_totalprice > 100000")


@query("SRC09_json_lines", "SELECT doc_id, lang, n_chars FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    where = shared_path(spark)
    d.write.json(where)
    return spark.read.schema(d.schema).json(where)


@query("SRC10_stem_list", "SELECT source AS stem, count(*) AS n FROM documents GROUP BY 1")
def stem_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_path(spark)
    d = table(spark, sf_dir, "documents")
    d.groupBy((F.col("doc_id") % 50).alias("k")).agg(F.array_join(F.collect_list("source"), ", ").alias("value")).select("value").write.text(where)
    return files.stem_list(spark, where).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


sql_query("SRC12_size_rollup", "SELECT source, lang, count(*) AS n, sum(n_chars) AS size FROM {documents} GROUP BY ROLLUP (source, lang)", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ROLLUP (source, lang)")
sql_query("SRC13_key_coalescing", "SELECT coalesce(nullif(url, ''), CAST(page_id AS STRING)) AS ref, min(page_id) AS first_id FROM {pages} GROUP BY 1", "SELECT coalesce(nullif(url, ''), page_id::VARCHAR) AS ref, min(page_id) AS first_id FROM pages GROUP BY 1")
sql_query("SRC15_sorted_scan", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40")
sql_query("SRC16_seeded_jitter", "SELECT s_suppkey, round(s_acctbal + CAST(conv(substring(md5(concat('7-', CAST(s_suppkey AS STRING))), 1, 6), 16, 10) AS BIGINT) / 16777216 * 12 - 6, 6) AS v FROM {supplier}",
    "SELECT s_suppkey, round(s_acctbal + ('0x' || substr(md5('7-' || s_suppkey::VARCHAR), 1, 6))::BIGINT / 16777216 * 12 - 6, 6) AS v FROM supplier")


@query(
    "SNK01_unified_table",
    f"""WITH {CAND}, r AS (SELECT dataset, 'node' AS row_type, node_id, t::BIGINT AS t, greatest(0, round_even(z, 0)::BIGINT) AS z, greatest(0, round_even(y, 0)::BIGINT) AS y, greatest(0, round_even(x, 0)::BIGINT) AS x, -1::BIGINT AS source_id, -1::BIGINT AS target_id FROM pts
    UNION ALL SELECT dataset, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM cand) SELECT row_number() OVER (ORDER BY dataset, row_type DESC, t, node_id, source_id, target_id) - 1 AS id, * FROM r""",
)
def unified_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unified_rows(points(spark, sf_dir), candidate_edges(spark, sf_dir))


sql_query("SNK02_sorted_statistics", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM {documents} GROUP BY source ORDER BY source")


@query("SNK04_nan_to_null_json", "SELECT '{\"c_custkey\":' || c_custkey || ',\"v\":' || CASE WHEN c_custkey % 5 = 0 THEN 'null' ELSE (c_custkey % 7)::DOUBLE::VARCHAR END || '}' AS json FROM customer")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 5 == 0, F.lit(float("inf"))).otherwise((F.col("c_custkey") % 7).cast("double"))
    return files.null_safe_json(table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")))


@query("SNK05_parquet_round_trip", "SELECT p_partkey, p_brand, p_size FROM part")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "part")


@query("SNK06_array_packs", "SELECT label, count(*) AS n, len(embedding)::INTEGER AS width FROM embeddings GROUP BY label, len(embedding)")
def array_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = checkpointed(table(spark, sf_dir, "embeddings"), "packs")
    return e.groupBy("label", F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).select("label", "n", "width")


@query("SNK08_shard_merge", "SELECT o_orderkey, o_custkey FROM orders")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return files.merge_shards([o.where(f"o_orderkey % 3 = {i}") for i in range(3)], o, "o_orderkey")


@query("SNK09_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment"))
    return files.upsert(c, new, "c_custkey")


sql_query("SNK10_recent_log", "SELECT event_id, event_type FROM {events} ORDER BY event_id DESC LIMIT 50")
sql_query("SNK11_ledger_update", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 THEN 'updated' ELSE o_orderstatus END AS status FROM {orders}")
sql_query("SNK12_last_value_by_key", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS last_type FROM {events} GROUP BY user_id", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM events GROUP BY user_id")

sql_query("VA02_id_sequence", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, max(event_id) - min(event_id) + 1 = count(*) AS gapless FROM {events}")
sql_query("VA03_finite_values", "SELECT count_if(c_acctbal IS NULL) AS nulls, count_if(isnan(c_acctbal)) AS nans FROM {customer}", "SELECT count_if(c_acctbal IS NULL)::BIGINT AS nulls, count_if(isnan(c_acctbal))::BIGINT AS nans FROM customer")
sql_query("VA04_coverage", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL)")


@query("VA05_bounds", f"WITH {PTS}, b AS (SELECT dataset, quantile_cont(z, 0.99) AS hi FROM pts GROUP BY dataset) SELECT p.dataset, p.node_id FROM pts p JOIN b USING (dataset) WHERE p.z > b.hi OR p.t < 0 OR p.t > 4")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return p.join(p.groupBy("dataset").agg(F.percentile("z", F.lit(0.99)).alias("hi")), "dataset").where("z > hi or t < 0 or t > 4").select("dataset", "node_id")


@query("VA06_unused_fields", f"WITH {CAND} SELECT (SELECT count(*) FROM pts) + (SELECT count(*) FROM cand) AS rows_ok, 0::BIGINT AS rows_bad")
def unused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = files.unified_rows(points(spark, sf_dir), candidate_edges(spark, sf_dir))
    ok = F.when(F.col("row_type") == "node", (F.col("source_id") == -1) & (F.col("target_id") == -1)).otherwise((F.col("node_id") == -1) & (F.col("t") == -1))
    return u.agg(F.count_if(ok).alias("rows_ok"), F.count_if(~ok).alias("rows_bad"))


@query("VA07_adjacent_frames", f"WITH {CAND} SELECT count(*) AS n, 0::BIGINT AS bad FROM cand")
def adjacent_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = candidate_edges(spark, sf_dir), points(spark, sf_dir)
    at = lambda n, t: p.select("dataset", F.col("node_id").alias(n), F.col("t").alias(t))
    e = e.join(at("source_id", "ts"), ["dataset", "source_id"], "left").join(at("target_id", "tt"), ["dataset", "target_id"], "left")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("tt") != F.col("ts") + 1, F.lit(True))).alias("bad"))


@query("VA08_degree_limits", f"WITH {CAND} SELECT dataset, source_id, count(*) AS n FROM cand GROUP BY dataset, source_id HAVING count(*) > 2")
def degree_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_edges(spark, sf_dir).groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


sql_query("VA09_unique_pairs", "SELECT l_orderkey, l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")
sql_query("VA10_run_equality", "SELECT count(*) AS n, max(abs(a.l_tax - b.l_tax)) AS worst FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
sql_query("VA11_manifest", "SELECT lang, count(*) AS n, min(sha2(text, 256)) AS first_digest FROM {documents} GROUP BY lang", "SELECT lang, count(*) AS n, min(sha256(text)) AS first_digest FROM documents GROUP BY lang")
sql_query("VA12_rederived_totals", "SELECT s.n = t.n AS same FROM (SELECT sum(n) AS n FROM (SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY l_returnflag)) s CROSS JOIN (SELECT count(*) AS n FROM {lineitem}) t")
sql_query("VA13_config_drift", "SELECT a.p_partkey FROM {part} a JOIN {part} b ON a.p_partkey = b.p_partkey WHERE abs(a.p_retailprice - b.p_retailprice * CASE WHEN b.p_partkey % 13 = 0 THEN 1.001D ELSE 1D END) > 1e-6", "SELECT p_partkey FROM part WHERE p_partkey % 13 = 0 AND abs(p_retailprice * 0.001) > 1e-6")

sql_query("UD06_logit_mean", "SELECT l_orderkey, l_linenumber, round((ln((l_discount + 0.01) / (1.01 - l_discount)) + ln((l_tax + 0.01) / (1.01 - l_tax))) / 2, 6) AS logit FROM {lineitem}")


@query("UD12_tracklet_mean", "SELECT a.vec_id, round(list_dot_product(list_transform(range(1, 65), lambda i: (a.embedding[i] + b.embedding[i] + c.embedding[i])::DOUBLE / 3), a.embedding::DOUBLE[]), 4) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2")
def tracklet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dot

    e = table(spark, sf_dir, "embeddings")
    at = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n))
    both = at(0, "u").join(at(1, "v"), "vec_id").join(at(2, "w"), "vec_id")
    total = F.zip_with(F.zip_with("u", "v", lambda x, y: x + y), "w", lambda x, y: (x + y).cast("double") / 3)
    return both.select("vec_id", F.round(dot(total, F.col("u")), 4).alias("sim"))


sql_query("UD14_sequence_expansion", "SELECT o_orderkey, k FROM (SELECT o_orderkey, explode(sequence(1, CAST(1 + o_orderkey % 3 AS INT))) AS k FROM {orders})", "SELECT o_orderkey, k::INTEGER AS k FROM orders, unnest(range(1, 2 + o_orderkey % 3)) u(k)")


#: Frames and voxels of the movies.
SHAPE = (5, 4, 32, 32)
_OUT = " OR ".join(f"{c} NOT BETWEEN 0 AND {m - 1}" for c, m in zip(("t", "z", "y", "x"), SHAPE, strict=True))


@query(
    "VA01_validation_report",
    f"""WITH u AS ({ORACLE_SQL['SNK01_unified_table']}), n AS (SELECT dataset, node_id, min(t) AS t, count(*) AS k FROM u WHERE row_type = 'node' GROUP BY 1, 2), e AS (SELECT * FROM u WHERE row_type = 'edge'),
    j AS (SELECT a.t AS ts, b.t AS tt FROM e LEFT JOIN n a ON a.dataset = e.dataset AND a.node_id = e.source_id LEFT JOIN n b ON b.dataset = e.dataset AND b.node_id = e.target_id)
    SELECT 'ids' AS rule, count(*) - count(DISTINCT id) AS violations FROM u UNION ALL SELECT 'id_range', count(*) FILTER (WHERE id < 0 OR id >= (SELECT count(*) FROM u)) FROM u
    UNION ALL SELECT 'nulls', count(*) FILTER (WHERE id IS NULL OR dataset IS NULL OR node_id IS NULL OR t IS NULL OR z IS NULL) FROM u UNION ALL SELECT 'row_type', count(*) FILTER (WHERE row_type NOT IN ('node', 'edge')) FROM u
    UNION ALL SELECT 'bounds', count(*) FILTER (WHERE row_type = 'node' AND ({_OUT})) FROM u UNION ALL SELECT 'node_fields', count(*) FILTER (WHERE row_type = 'node' AND (source_id <> -1 OR target_id <> -1)) FROM u
    UNION ALL SELECT 'edge_fields', count(*) FILTER (WHERE node_id <> -1 OR t <> -1 OR z <> -1 OR y <> -1 OR x <> -1) FROM e UNION ALL SELECT 'self_edge', count(*) FILTER (WHERE source_id = target_id) FROM e
    UNION ALL SELECT 'missing_node', count(*) FILTER (WHERE ts IS NULL OR tt IS NULL) FROM j UNION ALL SELECT 'not_adjacent', count(*) FILTER (WHERE tt <> ts + 1) FROM j UNION ALL SELECT 'duplicate_node', count(*) FROM n WHERE k > 1
    UNION ALL SELECT 'out_degree', count(*) FROM (SELECT 1 FROM e GROUP BY dataset, source_id HAVING count(*) > 2) UNION ALL SELECT 'in_degree', count(*) FROM (SELECT 1 FROM e GROUP BY dataset, target_id HAVING count(*) > 1)""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate links as one table: links of near points break the degree rules, large coordinates the bounds."""
    rows = checkpointed(unified_table(spark, sf_dir), "unified")
    return files.validation_report(rows, SUBMISSION_COLUMNS, SHAPE)
