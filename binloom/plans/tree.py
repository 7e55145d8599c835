"""The filter tree over user bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.operators import flat, inspect, tree
from binloom.session import shared_folder, table, written

_CONFIG = FilterConfig(disable_estimate_union=True, disable_rearrangement=True)


def _values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bins").select("user_bin_id", "value")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", "value", "threshold")


def _tree(spark: SparkSession, d: str, config: FilterConfig = _CONFIG) -> tree.Tree:
    return tree.build(_values(spark, d), config)


def tree_membership(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the user bins that hold enough of their values: how many there are, how many of them the tree misses,
    and whether at most as many others are found as the rate of false positives allows among all user bins."""
    index, asked, values = _tree(spark, d), _queries(spark, d), _values(spark, d)
    found = written(tree.membership(index, asked, "threshold"), "found")
    right = written(tree.verified(found, values, asked, "threshold"), "right")
    limits = asked.filter("value IS NOT NULL").groupBy("query_id").agg(F.max("threshold").alias("t"))
    held = values.filter("user_bin_id IS NOT NULL").distinct()
    mult = asked.filter("value IS NOT NULL").groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("m"))
    truth = mult.join(held, "value").groupBy("query_id", "user_bin_id").agg(F.sum("m").alias("cnt")).join(limits, "query_id").filter("cnt >= t")
    missed = truth.join(found, ["query_id", "user_bin_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("missed"))
    wrong, all_pairs = found.count() - right.count(), limits.count() * index.user_bins.count()
    bounded = wrong <= index.config.maximum_fpr * all_pairs
    return (
        right.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(missed, "query_id", "left")
        .select("query_id", "n", F.coalesce("missed", F.lit(0)).alias("missed"), F.lit(bounded).alias("bounded"))
    )


def tree_membership_verified(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    found = tree.count(_tree(spark, d), asked, "threshold")
    return tree.verified(found, _values(spark, d), asked, "threshold").select("query_id", "user_bin_id")


def tree_unions(spark: SparkSession, d: str) -> DataFrame:
    """Membership from a tree over ``bins`` that is planned with union estimates and rearrangement."""
    asked = _queries(spark, d)
    found = tree.count(_tree(spark, d, FilterConfig(sketch_bits=8)), asked, "threshold")
    return tree.verified(found, _values(spark, d), asked, "threshold").select("query_id", "user_bin_id")


def tree_count_verified(spark: SparkSession, d: str) -> DataFrame:
    return tree.count_verified(_tree(spark, d), _values(spark, d), _queries(spark, d))


def ratio_threshold_search(spark: SparkSession, d: str) -> DataFrame:
    asked = tree.ratio_thresholds(_queries(spark, d), 0.7)
    found = tree.count(_tree(spark, d), asked, "threshold")
    return tree.verified(found, _values(spark, d), asked, "threshold").select("query_id", "user_bin_id", "cnt")


def tree_inspect(spark: SparkSession, d: str) -> DataFrame:
    """One row: user bins by the filters' own figures, and whether the figures of the filters agree with each other."""
    shapes = written(inspect.inspect_tree(_tree(spark, d)), "shapes")
    return shapes.agg(
        F.sum("user_bins").alias("user_bins"),
        (F.sum("children") == F.count(F.lit(1)) - 1).alias("each_filter_has_a_parent"),
        F.bool_and((F.col("parent_ibf_id").isNull()) == (F.col("level") == 0)).alias("one_root"),
        F.bool_and((F.col("technical_bins") % 64 == 0) & (F.col("technical_bins") - F.col("bins")).between(0, 63)).alias("rounded"),
        F.bool_and(F.col("bit_size") == F.col("technical_bins") * F.col("bin_size")).alias("sized"),
        F.bool_and(F.col("children") + F.col("user_bins") + F.col("empty_bins") <= F.col("technical_bins")).alias("fit"),
    )


def tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row: user bins, whether the words are within the bits, and whether no technical bin has more of its bits set than its rate allows."""
    index = _tree(spark, d)
    total = inspect.totals(index)
    rate = F.pow(F.col("bits") / F.col("bin_size"), F.col("hash_funs"))
    fills = flat.fill_rate(index.words).join(index.meta, "ibf_id").agg(F.max(rate).alias("worst"))
    # A merged bin next to a filter's fullest one may be fuller than estimated.
    return total.crossJoin(F.broadcast(fills)).select(  # one row each
        "user_bins", (F.col("word_bytes") * 8 <= F.col("total_bits") * 1.0).alias("within"), (F.col("worst") <= index.config.relaxed_fpr * 1.5).alias("kept")
    )


def tree_bins(spark: SparkSession, d: str) -> DataFrame:
    """User bins in the tree, each once."""
    return _tree(spark, d).tb_map.filter("kind = 'user'").select("user_bin_id").distinct()


def tree_saved(spark: SparkSession, d: str) -> DataFrame:
    """Membership from a tree that was saved and loaded again."""
    path = f"{shared_folder(spark)}/binloom-saved-{spark.sparkContext.applicationId}"
    _tree(spark, d).save(path)
    asked = _queries(spark, d)
    found = tree.count(tree.Tree.load(spark, path), asked, "threshold")
    return tree.verified(found, _values(spark, d), asked, "threshold").select("query_id", "user_bin_id")


QUERIES = {
    f.__name__: f
    for f in (tree_membership, tree_membership_verified, tree_unions, tree_count_verified, ratio_threshold_search, tree_inspect, tree_totals, tree_bins, tree_saved)
}

_HELD = """
    held AS (SELECT DISTINCT user_bin_id, value FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL),
    counted AS (SELECT query_id, user_bin_id, count(*) AS cnt FROM queries JOIN held USING (value) GROUP BY 1, 2),
    lim AS (SELECT query_id, max(threshold) AS t, floor(count(value) * 0.7::DOUBLE)::BIGINT AS r FROM queries GROUP BY 1)
"""
_MEMBERS = f"WITH {_HELD} SELECT query_id, user_bin_id FROM counted JOIN lim USING (query_id) WHERE cnt >= t"

SQL = {
    "tree_membership": f"""
        WITH {_HELD} SELECT query_id, count(*) AS n, 0::BIGINT AS missed, true AS bounded FROM counted JOIN lim USING (query_id) WHERE cnt >= t GROUP BY 1
    """,
    "tree_inspect": f"""
        WITH {_HELD} SELECT count(DISTINCT user_bin_id)::BIGINT AS user_bins, true AS each_filter_has_a_parent, true AS one_root, true AS rounded, true AS sized, true AS fit FROM held
    """,
    "tree_totals": f"WITH {_HELD} SELECT count(DISTINCT user_bin_id)::BIGINT AS user_bins, true AS within, true AS kept FROM held",
    "tree_membership_verified": _MEMBERS,
    "tree_unions": _MEMBERS,
    "tree_saved": _MEMBERS,
    "tree_count_verified": f"WITH {_HELD} SELECT query_id, user_bin_id, cnt FROM counted",
    "ratio_threshold_search": f"WITH {_HELD} SELECT query_id, user_bin_id, cnt FROM counted JOIN lim USING (query_id) WHERE cnt >= r",
    "tree_bins": "SELECT DISTINCT user_bin_id FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL",
}
