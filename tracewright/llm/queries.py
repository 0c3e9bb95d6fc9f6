"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, filter_audit, line_dedup, media, mixing, ngram_join, pii, sharding, source_divergence, substring_dedup, token_counts, toxicity
from .common import table


#: A key for the registered query; production passes its own secret.
PSEUDONYM_KEY = "corpus-1"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op3_byte_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the vocabulary's place; only this query needs it

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_byte_prefix_sharding": op3_byte_prefix_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_source_mixing": op5_source_mixing,
    "op6_flac_media": op6_flac_media,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_fuzzy_line_dedup": op10_fuzzy_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), g AS (
            SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[]
                WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM w
        ), n AS (
            SELECT doc_id, len(g)::BIGINT AS n FROM g
        ), s AS (
            SELECT doc_id, n, unnest(g) AS x FROM g JOIN n USING (doc_id)
        ), link AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) = any_value(a.n) AND any_value(a.n) = any_value(b.n) AS same
            FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n
            UNION
            SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), c AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        ), l AS (
            SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS least FROM link GROUP BY a
        )
        SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, COALESCE(l.least, n.doc_id)) AS class_id, c.component_id,
            COALESCE(l.n_links, 0)::BIGINT AS n_links
        FROM n JOIN c ON c.a = n.doc_id LEFT JOIN l ON l.a = n.doc_id
    """,
    "op7_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), v AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20
        ), seen AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again FROM v
        ), gone AS (
            SELECT DISTINCT doc_id, i + j AS p FROM seen, range(20) AS r(j) WHERE again
        ), lost AS (
            SELECT doc_id, list(p) AS lost FROM gone GROUP BY doc_id
        ), cut AS (
            SELECT w.doc_id, len(w.w) AS n, COALESCE(len(lost), 0) AS n_removed,
                CASE WHEN lost IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1),
                    lambda p: NOT list_contains(lost, p)), lambda p: w.w[p]) END AS kept
            FROM w LEFT JOIN lost USING (doc_id)
        )
        SELECT doc_id, n::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(COALESCE(array_to_string(kept, ' '), '')) AS kept_sha256 FROM cut
    """,
    "op3_byte_prefix_sharding": """
        WITH crc AS (
            SELECT list(v ORDER BY i) AS t FROM (
                SELECT i, list_reduce([i::BIGINT] || range(8)::BIGINT[],
                    lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
                FROM range(256) r(i))
        ), d AS (
            SELECT doc_id, (COALESCE(octet_length(encode(text)), 0) + 16)::BIGINT AS size, hex(encode(COALESCE(text, ''))) AS x
            FROM documents
        ), s AS (
            SELECT doc_id, size, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(
                    regexp_extract_all(x, '..'), lambda b: ('0x' || b)::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
            FROM d, crc
        ), p AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
                sum(size) OVER () AS total
            FROM s
        ), q AS (
            SELECT *, least(39, ((2 * before + size) * 40) // (2 * total))::INTEGER AS shard FROM p
        )
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
            (row_number() OVER (PARTITION BY shard ORDER BY before) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
        FROM q
    """,
    "op5_source_mixing": r"""
        WITH n AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS nth FROM documents
        ), d AS (
            SELECT doc_id, source,
                COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                ('0x' || substr(md5(md5(COALESCE(doc_id::VARCHAR, '') || '|' || COALESCE(source, '') || '|'
                    || (text IS NULL)::VARCHAR || md5(COALESCE(text, ''))) || ' ' || nth), 1, 8))::BIGINT >> 2 AS h
            FROM n
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w
            FROM d GROUP BY source
        ), levels AS (
            SELECT s.*, (SELECT sum(source_size) * 1.5 - sum(CASE WHEN o.source_size * 2 / o.w < s.source_size * 2 / s.w THEN 2 * o.source_size ELSE 0 END) FROM s o) AS room,
                (SELECT sum(CASE WHEN o.source_size * 2 / o.w < s.source_size * 2 / s.w THEN 0 ELSE o.w END) FROM s o) AS ws
            FROM s
        ), level AS (
            SELECT arg_max(room::DOUBLE / ws, ws) AS level FROM levels WHERE room * w < 2 * source_size * ws
        ), t AS (
            SELECT source, source_size, least(2.0 * source_size, COALESCE(level * w, 2.0 * source_size))::DOUBLE AS target
            FROM s, level
        ), r AS (
            SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), c AS (
            SELECT *, (CASE WHEN upto <= floor(least(target, source_size)) THEN 1 ELSE 0 END
                + CASE WHEN upto <= floor(greatest(target - source_size, 0)) THEN 1 ELSE 0 END)::INTEGER AS copies
            FROM r
        )
        SELECT doc_id, size, source, source_size, round(target, 3) AS target, copies, (size * copies)::BIGINT AS taken FROM c
    """,
    "op9_chat_formatting": """
        WITH k AS (
            SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS said
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), one AS (
            SELECT min(conv_id) AS conv_id, said, count(*) AS n_same FROM k GROUP BY said
        ), inner_ AS (
            SELECT DISTINCT said[1:i] AS said FROM k, unnest(range(1, len(said))) AS u(i)
        )
        SELECT conv_id, len(said)::BIGINT AS n_turns, n_same::BIGINT AS n_same,
            list_aggregate(list_transform(said, lambda x: '<|im_start|>' || COALESCE(x.r, '') || chr(10)
                || COALESCE(x.t, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
        FROM one WHERE said NOT IN (SELECT said FROM inner_)
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
                regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS said
            FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(said) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
        ), dense AS (
            SELECT g.lang, g.source, kept.term, COALESCE(c.n, 0) AS n
            FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
        ), p AS (
            SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER s + count(*) OVER s)::HUGEINT AS p FROM dense WINDOW s AS (PARTITION BY lang, source)
        ), whole AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT // (sum(sum(n)) OVER s + count(*) OVER s)::HUGEINT AS p FROM dense GROUP BY lang, term WINDOW s AS (PARTITION BY lang)
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), all_pairs AS (
            SELECT a.lang, a.source, b.source AS item, COALESCE(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        ), terms AS (
            SELECT p.lang, p.source, p.term AS item, (p.p - q.p) * (p.p - q.p) // q.p AS value
            FROM p JOIN whole q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p.p > q.p
        ), ranked AS (
            SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM all_pairs
            UNION ALL
            SELECT 'term' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 200
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    """,
    "op13_filter_interactions": r"""
        WITH RECURSIVE o(filter_order, left_over) AS (
            SELECT '', 'ABCDE'
            UNION ALL
            SELECT filter_order || l, replace(left_over, l, '') FROM o, unnest(string_split(left_over, '')) AS u(l) WHERE left_over <> ''
        ), steps AS (
            SELECT filter_order, s::INTEGER AS step, filter_order[:s - 1] AS before, filter_order[s] AS letter
            FROM o, range(1, 6) AS t(s) WHERE left_over = ''
        ), d AS (
            SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), lab AS (
            SELECT doc_id, COALESCE(max(quality = 1), false) AS good, COALESCE(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
        ), f AS (
            SELECT part, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic,
                CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM d LEFT JOIN lab USING (doc_id)
        ), k AS (
            SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY ALL
        ), j AS (
            SELECT k.*, steps.*, before = '' OR NOT regexp_matches(fails, '[' || before || '_]') AS passed, contains(fails, letter) AS hit FROM k, steps
        )
        SELECT part, filter_order, step,
            COALESCE(sum(n) FILTER (passed AND NOT hit), 0)::BIGINT AS kept,
            COALESCE(sum(n) FILTER (passed AND hit), 0)::BIGINT AS removed,
            COALESCE(sum(n) FILTER (NOT passed AND hit), 0)::BIGINT AS redundant,
            COALESCE(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
            COALESCE(sum(n_good) FILTER (passed AND hit), 0)::BIGINT AS good_lost,
            COALESCE(sum(n_toxic) FILTER (passed AND hit), 0)::BIGINT AS toxic_lost,
            (sum(COALESCE(sum(n) FILTER (passed AND hit), 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM j GROUP BY part, filter_order, step, letter
    """,
}
