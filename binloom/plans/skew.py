"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binloom.operators import skew
from binloom.session import scratch, table, written


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return skew.bin_profile(table(spark, d, "bins"), table(spark, d, "hierarchical_binning"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as keep:
        profile = keep(written(_profile(spark, d), "profile"))
    return skew.heavy_bins(profile)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile}

SQL = {
    "p5_found": """
        SELECT user_bin_id FROM bins WHERE user_bin_id IS NOT NULL GROUP BY user_bin_id
        HAVING count(*) >= 0.04 * (SELECT count(*) FROM bins)
    """,
    "p5_profile": """
        WITH b AS (
            SELECT user_bin_id, batch_id, count(*) AS n, count(DISTINCT value) AS d FROM bins GROUP BY 1, 2
        ), needs AS (
            SELECT user_bin_id, sum(n)::BIGINT AS n_rows, count(batch_id) AS n_batches,
                   coalesce(sum(ceil(d / tb_capacity)), 0)::BIGINT AS n_tbs
            FROM b LEFT JOIN hierarchical_binning USING (batch_id) GROUP BY 1
        ), whole AS (SELECT user_bin_id, count(DISTINCT value) AS kmer_counts FROM bins GROUP BY 1)
        SELECT n.user_bin_id, n_rows, kmer_counts, n_batches, n_tbs
        FROM needs n JOIN whole w ON n.user_bin_id IS NOT DISTINCT FROM w.user_bin_id
    """,
}
