"""The queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import clusters, distinct, leaks, overlaps, packing, residue, tokens
from binloom.session import table, written


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(
        table(spark, d, "bins"), table(spark, d, "clustering_node"), table(spark, d, "data_store")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.pairs(_grouped(spark, d))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(_grouped(spark, d))


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.members(_grouped(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    sets, strong = overlaps.overlaps(table(spark, d, "bins"))
    return overlaps.strong_pairs(sets, strong).select("user_bin_a", "user_bin_b")


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    sets, strong = overlaps.overlaps(table(spark, d, "bins"))
    return overlaps.strong_pairs(sets, strong)


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Every large user bin with the smallest of those equal to it: with p3_classes the compact form of p3_overlaps."""
    return overlaps.overlaps(table(spark, d, "bins"))[0]


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlaps(table(spark, d, "bins"))[1]


def p2_distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = written(distinct.partials(table(spark, d, "bins")), "partials")
    return distinct.distinct_counts(parts, table(spark, d, "group_sets"))


def p2_partials(spark: SparkSession, d: str) -> DataFrame:
    return distinct.partials(table(spark, d, "bins"))


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Estimates against exact counts."""
    return distinct.kept_bounds(p2_distinct(spark, d), distinct.exact_counts(table(spark, d, "bins"), table(spark, d, "group_sets")))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    things = written(packing.items(table(spark, d, "data_store"), table(spark, d, "bins")), "items")
    return packing.packed(things, table(spark, d, "hierarchical_binning"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d).filter("n_tbs > 1").select("user_bin_id", "batch_id")


def p4_layout(spark: SparkSession, d: str) -> DataFrame:
    return _layout(spark, d)


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_layout(spark, d), table(spark, d, "hierarchical_binning"))


def p1_typical(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size, how many typical members are told, and whether these are members and alike on average."""
    grouped = _grouped(spark, d)
    told = clusters.described(grouped)
    named = clusters.members(grouped).select("user_bin_id", "first_bin", F.col("size").alias("n"))
    typical = told.select("cluster", "size", "mean_similarity", F.explode("typical_bins").alias("user_bin_id")).join(named, "user_bin_id")
    return typical.groupBy("cluster", "size", "mean_similarity").agg(
        F.min("first_bin").alias("first_bin"),
        F.count(F.lit(1)).alias("typical"),
        (F.min("first_bin") == F.max("first_bin")).alias("one"),
    ).select("first_bin", "size", "typical", (F.col("one") & (F.col("mean_similarity") >= 0.4)).alias("alike"))


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    return packing.checked(_layout(spark, d), table(spark, d, "hierarchical_binning"))


#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = tokens.Vocabulary.read(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return tokens.encoded(table(spark, d, "documents"), vocabulary)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return residue.clean(documents, residue.residue(documents)).select("doc_id", "lang", "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p1_members": p1_members,
    "p1_typical": p1_typical,
    "p2_distinct": p2_distinct,
    "p2_partials": p2_partials,
    "p2_bounds": p2_bounds,
    "p4_found": p4_found,
    "p4_layout": p4_layout,
    "p4_fill": p4_fill,
    "p4_checked": p4_checked,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p3_found": p3_found,
    "p3_overlaps": p3_overlaps,
    "p3_members": p3_members,
    "p3_classes": p3_classes,
}

_OVERLAPS = """
    WITH v AS (SELECT DISTINCT user_bin_id AS b, value AS v FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL),
    n AS (SELECT b, count(*) AS n FROM v GROUP BY b HAVING count(*) >= 100),
    k AS (
        SELECT x.b AS a, y.b AS b, count(*) AS k FROM v x JOIN v y ON x.v = y.v AND x.b < y.b
        WHERE x.b IN (SELECT b FROM n) AND y.b IN (SELECT b FROM n) GROUP BY 1, 2
    )
    SELECT k.a AS user_bin_a, k.b AS user_bin_b, k AS shared, least(p.n, q.n) AS n_small
    FROM k JOIN n p ON p.b = k.a JOIN n q ON q.b = k.b WHERE k >= 0.2 * least(p.n, q.n)
"""

#: The similar pairs of user bins with a leaf; on these tables similarity is transitive, so they are the clusters too.
_LIKE = """
    v AS (
        SELECT DISTINCT user_bin_id AS b, value AS v FROM bins
        WHERE value IS NOT NULL AND user_bin_id IN (SELECT user_bin_id FROM clustering_node WHERE user_bin_id IS NOT NULL)
    ), n AS (SELECT b, count(*) AS n FROM v GROUP BY b),
    k AS (SELECT x.b AS a, y.b AS b, count(*) AS k FROM v x JOIN v y ON x.v = y.v AND x.b < y.b GROUP BY 1, 2),
    pairs AS (SELECT k.a, k.b FROM k JOIN n p ON p.b = k.a JOIN n q ON q.b = k.b WHERE k >= 0.4 * (p.n + q.n - k))
"""
_EQUAL = """
    v AS (SELECT DISTINCT user_bin_id AS b, value AS v FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL),
    w AS (SELECT b, count(*) AS n, list(v ORDER BY v) AS l FROM v GROUP BY b HAVING count(*) >= 100),
    m AS (SELECT b, min(b) OVER (PARTITION BY l) AS rep, n FROM w)
"""

# XXH64 of eight bytes with seed 42, in unsigned 128-bit arithmetic; then level, bit and word.
_BITMAP = """
    u AS (
        SELECT batch_id, strftime(seen_at, '%Y-%m-%d') AS day, lower(trim(sample_group)) AS sample_group,
               (CASE WHEN value < 0 THEN value::HUGEINT + 18446744073709551616 ELSE value END)::UHUGEINT AS k
        FROM bins WHERE value IS NOT NULL
    ),
    a AS (SELECT * EXCLUDE k, (k * 14029467366897019727) % 18446744073709551616 AS h FROM u),
    b AS (SELECT * EXCLUDE h, ((h % 8589934592) * 2147483648 + h // 8589934592) * 11400714785074694791 % 18446744073709551616 AS h FROM a),
    c AS (SELECT * EXCLUDE h, xor(2870177450012600311::UHUGEINT, h) AS h FROM b),
    e AS (SELECT * EXCLUDE h, (((h % 137438953472) * 134217728 + h // 137438953472) * 11400714785074694791 % 18446744073709551616 + 9650029242287828579) % 18446744073709551616 AS h FROM c),
    f AS (SELECT * EXCLUDE h, xor(h, h // 8589934592) * 14029467366897019727 % 18446744073709551616 AS h FROM e),
    g AS (SELECT * EXCLUDE h, xor(h, h // 536870912) * 1609587929392839161 % 18446744073709551616 AS h FROM f),
    x AS (SELECT * EXCLUDE h, xor(h, h // 4294967296) AS h FROM g),
    bits AS (
        SELECT DISTINCT batch_id, day, sample_group, 32 - length(bin((h // 4294967296)::BIGINT)) AS level, (h % 4096)::INT AS bit FROM x
    )
"""

SQL = {
    "p2_bounds": """
        WITH c AS (SELECT DISTINCT strftime(seen_at, '%Y-%m-%d') AS day, lower(trim(sample_group)) AS g, value AS v FROM bins WHERE value IS NOT NULL),
        m AS (SELECT DISTINCT set_id, lower(trim(sample_group)) AS g FROM group_sets WHERE sample_group IS NOT NULL),
        s AS (SELECT set_id, day, v FROM c JOIN m USING (g)),
        e AS (
            SELECT 'day' AS scope, count(DISTINCT v) AS n FROM c GROUP BY day
            UNION ALL SELECT 'group', count(DISTINCT v) FROM c GROUP BY g
            UNION ALL SELECT 'day_group', count(DISTINCT v) FROM c GROUP BY day, g
            UNION ALL SELECT 'set', count(DISTINCT v) FROM s GROUP BY set_id
            UNION ALL SELECT 'day_set', count(DISTINCT v) FROM s GROUP BY set_id, day
        )
        SELECT scope, count(*) AS n, sum(n)::BIGINT AS total, true AS kept FROM e GROUP BY 1
    """,
    "p2_partials": f"""
        WITH {_BITMAP}
        SELECT batch_id, day, sample_group, (level * 64 + bit // 64)::INT AS slot,
               (CASE WHEN w >= 9223372036854775808 THEN w::HUGEINT - 18446744073709551616 ELSE w::HUGEINT END)::BIGINT AS word
        FROM (SELECT batch_id, day, sample_group, level, bit // 64 * 64 AS bit, bit_or(1::UBIGINT << (bit % 64)) AS w FROM bits GROUP BY 1, 2, 3, 4, 5)
    """,
    "p2_distinct": f"""
        WITH {_BITMAP},
        cells AS (SELECT DISTINCT day, sample_group, level, bit FROM bits),
        members AS (SELECT DISTINCT set_id, lower(trim(sample_group)) AS sample_group FROM group_sets),
        scoped AS (
            SELECT DISTINCT 'day' AS scope, day, NULL::VARCHAR AS sample_group, NULL::VARCHAR AS set_id, level, bit FROM cells
            UNION ALL SELECT DISTINCT 'group', NULL, sample_group, NULL, level, bit FROM cells
            UNION ALL SELECT DISTINCT 'day_group', day, sample_group, NULL, level, bit FROM cells
            UNION ALL SELECT DISTINCT 'set', NULL, NULL, set_id::VARCHAR, level, bit FROM cells JOIN members USING (sample_group)
            UNION ALL SELECT DISTINCT 'day_set', day, NULL, set_id::VARCHAR, level, bit FROM cells JOIN members USING (sample_group)
        ),
        levels AS (SELECT scope, day, sample_group, set_id, level, count(*) AS ones FROM scoped GROUP BY ALL),
        based AS (
            SELECT *, least(31, coalesce(max(CASE WHEN ones > 0.9 * 4096 THEN level + 1 END) OVER (PARTITION BY scope, day, sample_group, set_id), 0)) AS base
            FROM levels
        ),
        loads AS (SELECT *, -ln(greatest(4096 - ones, 1) / 4096.0::DOUBLE) AS t FROM based WHERE level >= base),
        sums AS (
            SELECT scope, day, sample_group, set_id, pow(2.0, any_value(base)) AS scale, 4096.0::DOUBLE * sum(t) AS m, 4096.0::DOUBLE * sum(exp(t) - t - 1) AS v
            FROM loads GROUP BY ALL
        )
        SELECT scope, day, sample_group, set_id, round(scale * m)::BIGINT AS estimate,
               round(3.0::DOUBLE * sqrt(v + m * (1 - 1 / scale)) / greatest(m, 1.0), 6) AS rel_error
        FROM sums
    """,
    "p4_checked": """
        WITH i AS (SELECT DISTINCT user_bin_id, batch_id FROM data_store WHERE user_bin_id IS NOT NULL),
        n AS (SELECT user_bin_id, batch_id, count(DISTINCT value) AS n FROM bins GROUP BY 1, 2)
        SELECT batch_id, count(*) AS n_items, sum(coalesce(n, 0))::BIGINT AS total, ceil(sum(coalesce(n, 0)) / max(tb_capacity))::BIGINT AS least_tbs,
               true AS fits, true AS gapless, true AS split_only_long, true AS tight
        FROM i JOIN hierarchical_binning USING (batch_id) LEFT JOIN n USING (user_bin_id, batch_id) WHERE tb_capacity > 0 GROUP BY 1
    """,
    "p4_found": """
        WITH i AS (SELECT DISTINCT user_bin_id, batch_id FROM data_store),
        n AS (SELECT user_bin_id, batch_id, count(DISTINCT value) AS n FROM bins GROUP BY 1, 2)
        SELECT user_bin_id, batch_id FROM i JOIN n USING (user_bin_id, batch_id) JOIN hierarchical_binning USING (batch_id)
        WHERE n > tb_capacity
    """,
    "p1_members": f"""
        WITH {_LIKE}
        SELECT l.b AS user_bin_id, least(l.b, coalesce(min(o), l.b)) AS first_bin, count(o) + 1 AS size
        FROM (SELECT DISTINCT user_bin_id AS b FROM clustering_node WHERE user_bin_id IS NOT NULL) l
        LEFT JOIN (SELECT a AS b, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) USING (b) GROUP BY 1, l.b
    """,
    "p1_typical": f"""
        WITH {_LIKE},
        c AS (
            SELECT l.b, least(l.b, coalesce(min(o), l.b)) AS first_bin
            FROM (SELECT DISTINCT user_bin_id AS b FROM clustering_node WHERE user_bin_id IS NOT NULL) l
            LEFT JOIN (SELECT a AS b, b AS o FROM pairs UNION ALL SELECT b, a FROM pairs) USING (b) GROUP BY l.b
        )
        SELECT first_bin, count(*) AS size, least(3, count(*)) AS typical, true AS alike FROM c GROUP BY 1
    """,
    "p1_found": f"WITH {_LIKE} SELECT a AS user_bin_a, b AS user_bin_b FROM pairs",
    "p3_found": f"SELECT user_bin_a, user_bin_b FROM ({_OVERLAPS})",
    "p3_overlaps": _OVERLAPS,
    "p3_members": f"WITH {_EQUAL} SELECT b AS user_bin_id, rep, n FROM m",
    "p3_classes": f"""
        WITH {_EQUAL}, r AS (SELECT b, n FROM m WHERE b = rep),
        k AS (
            SELECT p.b AS bin, q.b AS hub, count(*) AS shared, p.n AS n_bin, q.n AS n_hub
            FROM r p JOIN v x ON x.b = p.b JOIN v y USING (v) JOIN r q ON q.b = y.b
            WHERE (p.n, p.b) < (q.n, q.b) GROUP BY 1, 2, 4, 5
        )
        SELECT bin, hub, shared, n_bin, n_hub FROM k WHERE shared >= 0.2 * n_bin
    """,
}
