"""The k-mer front end: texts to values, and search and count over a tree."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.functions import hashing
from binloom.operators import tree


def bins_of(texts: DataFrame, id_column: str, text: str = "text", k: int = 20) -> DataFrame:
    """(user_bin_id, value): the k-mers of each sequence, one bin per id."""
    return hashing.kmers(texts, id_column, text, k).toDF("user_bin_id", "value")


def pairs_of(texts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(user_bin_id, value): the pairs of neighbouring characters of each text, of whatever alphabet."""
    return hashing.code_point_pairs(texts, id_column, text).toDF("user_bin_id", "value")


def values_of(rows: DataFrame, id_column: str, column: str, values: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(user_bin_id, value): whatever ``values`` makes of a column, a list of numbers for each row; null lists are empty.

    For inputs that no built-in expression turns into values. ``values`` gets a
    batch of rows as a series and returns one of the same length.
    """
    made = F.pandas_udf(values, "array<bigint>")
    return rows.select(F.col(id_column).cast("bigint").alias("user_bin_id"), F.explode(made(F.col(column))).alias("value"))


def queries_of(texts: DataFrame, id_column: str, text: str = "text", k: int = 20) -> DataFrame:
    return bins_of(texts, id_column, text, k).withColumnRenamed("user_bin_id", "query_id")


def build(texts: DataFrame, id_column: str, text: str = "text", k: int = 20, config: FilterConfig | None = None) -> tree.Tree:
    """A tree over the k-mers of each text; two hash functions and a rate of 0.05 by default."""
    return tree.build(bins_of(texts, id_column, text, k), config or FilterConfig(disable_estimate_union=True))


def search(index: tree.Tree, queries: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(query_id, user_bins): ids, in order, that hold ``ratio`` of a query's values, as text."""
    hits = tree.membership(index, tree.ratio_thresholds(queries, ratio), "threshold")
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list("user_bin_id")).alias("ids"))
    return listed.select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("user_bins"))


def counts(index: tree.Tree, queries: DataFrame, threshold: int = 1) -> DataFrame:
    """(query_id, user_bin_id, cnt) of every user bin; 0 where the count is below the threshold."""
    return tree.count_all(index, queries, threshold)
