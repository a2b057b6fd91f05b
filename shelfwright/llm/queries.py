"""The queries of the training-data operators, over whole tables with production parameters, and their SQL where SQL is feasible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwright.llm import components, mixing, mojibake, near_dup, pii, rnn_clusters, survivor, tree_tokens
from shelfwright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_pairs(table(spark, sf_dir, "snippets"), "id", "text", k=3, jaccard=0.6, weighted=0.45, min_words=30)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "snippets"), "id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.surviving_rows(table(spark, sf_dir, "files"), table(spark, sf_dir, "scans"), table(spark, sf_dir, "plan_deletes"))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.surviving_values(table(spark, sf_dir, "files"), table(spark, sf_dir, "scans"), table(spark, sf_dir, "plan_deletes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected(components.file_links(table(spark, sf_dir, "match_pairs"), table(spark, sf_dir, "graph_nodes")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "snippets"))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "snippets"), "id", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_clusters.found(table(spark, sf_dir, "cluster_results"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnn_clusters.described(table(spark, sf_dir, "cluster_results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def p8_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "masked")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_masked": p8_masked,
}

ORACLE: dict[str, str] = {
    "p1_found": """
        WITH t AS (SELECT DISTINCT id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM snippets WHERE id IS NOT NULL AND text IS NOT NULL),
        k AS (SELECT id, row_number() OVER () AS d, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 30),
        u AS (SELECT d, id, len(s) AS n, unnest(s) AS sh FROM k)
        SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.sh = b.sh AND a.id < b.id
        GROUP BY a.d, b.d, a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))
    """,
    "p2_found": """
        WITH r AS (
            SELECT f.*, s.trust FROM files f LEFT JOIN (SELECT scan_id, max(trust) AS trust FROM scans GROUP BY 1) s USING (scan_id)
            WHERE f.id IN (SELECT id FROM files GROUP BY id HAVING count(*) > 1)),
        p AS (SELECT id, arg_max(seq, (coalesce(trust, -999), -seq)) AS seq FROM r WHERE md5(path) = id GROUP BY id),
        m AS (SELECT id, arg_max(seq, (mtime, -seq)) AS seq FROM r WHERE mtime > 0 AND NOT isnan(mtime) AND mtime <= epoch_us(seen_at) / 1e6 GROUP BY id),
        h AS (SELECT id, arg_max(seq, (epoch_us(seen_at), -seq)) AS seq FROM r WHERE regexp_full_match(hash, '[0-9A-Fa-f]{64}') GROUP BY id),
        w AS (SELECT id, arg_max(plan_seq, (coalesce(confidence, -1e9), -plan_seq)) AS seq FROM plan_deletes
              WHERE regexp_matches(reason, '[\\p{L}\\p{N}]') AND lower(trim(reason)) NOT IN ('unknown', 'n/a', 'na', 'none', 'null', 'nil', 'tbd', 'tba', 'todo',
                    'unspecified', 'undefined', 'no reason', 'not available', 'not known', 'not set') GROUP BY id)
        SELECT i.id, coalesce(p.seq, 0) AS path_seq, coalesce(m.seq, 0) AS mtime_seq, coalesce(h.seq, 0) AS hash_seq, coalesce(w.seq, 0) AS reason_seq
        FROM (SELECT DISTINCT id FROM r) i LEFT JOIN p USING (id) LEFT JOIN m USING (id) LEFT JOIN h USING (id) LEFT JOIN w USING (id)
    """,
    "p3_found": """
        WITH RECURSIVE nodes AS (
            SELECT node_seq, unnest(meta.file_ids) AS x FROM graph_nodes WHERE kind IN ('duplicate_cluster', 'near_duplicate_text')),
        hubs AS (SELECT node_seq, min(x) AS hub FROM nodes GROUP BY 1),
        one AS (
            SELECT id_a AS a, id_b AS b FROM match_pairs WHERE is_match AND id_a <> id_b
            UNION SELECT hub, x FROM nodes JOIN hubs USING (node_seq) WHERE hub <> x),
        links AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT a AS id, min(b) AS group_id FROM reach GROUP BY a
    """,
}
