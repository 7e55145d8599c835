"""Ordering of user bins, set-based."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.session import written


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with each row's place among the rows of its key, from 0.

    Rows are range-partitioned by key and order, so a large key spreads over
    several tasks; each task numbers its own rows, and the few counts of earlier
    partitions of the key are added. Rows that tie in all of it are numbered in
    any order.
    """
    by = [F.col(k) for k in keys] + order
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = written(sorted_.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "ranked")
    groups = rows.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = groups.select(*keys, "__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        rows.join(offsets, [*keys, "__p"])
        .withColumn(out, F.col("__i") - F.col("__first") + F.col("__off"))
        .drop("__p", "__i", "__first", "__off")
    )


def running_sums(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum up to the row in ascending ``order``.

    Each range partition sums its own rows; the totals of earlier partitions,
    one row each, are added.
    """
    rows = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    rows = written(rows, "running")
    totals = rows.groupBy("__p").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select("__p", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    own = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "__p").select(
        *[((F.sum(c).over(own) + F.col(f"__{c}")).alias(c) if c in columns else F.col(c)) for c in df.columns]
    )


def sorted_bins(counts: DataFrame, key: str = "user_bin_id", size: str = "cardinality") -> DataFrame:
    """(key, size, position): largest first, ties to the smaller id."""
    return ranked(counts.select(key, size), [], [F.desc(size), F.asc(key)], "position").select(key, size, "position")


def intervals(positions: DataFrame, ratio: float) -> DataFrame:
    """(position, interval): a new interval begins where a bin is smaller than ``ratio`` times the interval's first.

    The first bins of intervals follow one from another, but hang on sizes only:
    one task walks down the distinct sizes, of which there are far fewer than
    bins, and the bins get their intervals by their size.
    """
    schema = pa.schema([("cardinality", pa.int64()), ("interval", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = None, -1
        for batch in batches:
            out = []
            for c in batch.column("cardinality").to_pylist():
                if first is None or first * ratio > c:
                    first, number = c, number + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column("cardinality"), pa.array(out, pa.int64())], schema=schema)

    rows = positions.select(F.col("position").cast("bigint").alias("position"), F.col("cardinality").cast("bigint").alias("cardinality"))
    sizes = rows.select("cardinality").distinct().coalesce(1).sortWithinPartitions(F.desc("cardinality"))
    return rows.join(sizes.mapInArrow(cut, "cardinality bigint, interval bigint"), "cardinality").select("position", "interval")
