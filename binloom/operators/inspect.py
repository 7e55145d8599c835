"""What a filter or a tree is made of. Bits and bytes are separate columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators.flat import Filter
from binloom.operators.tree import Tree


def inspect_filter(index: Filter) -> dict[str, int]:
    return {
        "user_bins": index.bins,
        "technical_bins": index.technical_bins,
        "empty_bins": index.technical_bins - index.bins,
        "bin_words": index.bin_words,
        "bin_size": index.bin_size,
        "bit_size": index.bit_size,
        "hash_functions": index.functions,
        "hash_shift": index.hash_shift,
    }


def inspect_tree(index: Tree) -> DataFrame:
    """A row per filter, by level and path: its shape, children and user bins."""
    kinds = index.tb_map.groupBy("ibf_id").agg(
        F.count_if(F.col("kind") == "merged").alias("children"),
        F.count_distinct("user_bin_id").alias("user_bins"),
        F.count_if(F.col("kind") == "empty").alias("gap_bins"),
    )
    return index.meta.join(kinds, "ibf_id").select(
        "ibf_id",
        "level",
        F.array_join(F.transform("path", lambda x: x.cast("string")), ";").alias("path"),
        "parent_ibf_id",
        "bins",
        "technical_bins",
        (F.col("technical_bins") - F.col("bins") + F.col("gap_bins")).alias("empty_bins"),
        "bin_size",
        (F.col("technical_bins") * F.col("bin_size")).alias("bit_size"),
        "hash_funs",
        "hash_shift",
        "children",
        "user_bins",
    )


def totals(index: Tree) -> DataFrame:
    """One row: filters, levels, bits, bytes of stored words, empty bins, user bins."""
    shape = inspect_tree(index).agg(
        F.count(F.lit(1)).alias("filters"),
        (F.max("level") + 1).alias("levels"),
        F.sum("bit_size").alias("total_bits"),
        F.sum("empty_bins").alias("empty_bins"),
        F.sum("user_bins").alias("user_bins"),
    )
    stored = index.words.agg((F.count(F.lit(1)) * 8).alias("word_bytes"))
    return shape.join(stored)  # one row each


def same(a: Tree, b: Tree) -> bool:
    """Whether two trees have equal tables and all options equal."""
    if a.config != b.config:
        return False
    for name in ("meta", "words", "tb_map", "user_bins"):
        x, y = getattr(a, name), getattr(b, name)
        y = y.select(*x.columns)
        if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
            return False
    return True
