"""Simulations of false positive rates and of hash collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.functions import sizing
from binloom.operators import flat


def _rate(spark: SparkSession, values: DataFrame, universe: int, bins: int, size: int, functions: int, seen: DataFrame) -> DataFrame:
    """One row: the part of the values never inserted that some bin seems to hold."""
    index = flat.build(values, bins, size, functions)
    probe = spark.range(universe).select(F.col("id").alias("value"))
    hit = flat.contains(index, probe).select("value").distinct().join(seen, "value", "left_anti")
    return hit.agg(F.count(F.lit(1)).alias("false_positives")).withColumn("asked", F.lit(universe) - F.lit(seen.count()))


def fpr_check(
    spark: SparkSession, k: int = 6, elements: int = 500, splits: int = 4, fpr: float = 0.05, functions: int = 2, seed: int = 1
) -> DataFrame:
    """(variant, bin_size, false_positives, asked, rate) for a single bin, and for a split one with and without correction.

    The universe is the ``4^k`` k-mers; the values inserted are those with the
    smallest hashes of ``seed``.
    """
    universe = 4**k
    chosen = spark.range(universe).select(F.col("id").alias("value")).orderBy(F.xxhash64("value", F.lit(seed))).limit(elements)
    order = chosen.withColumn("n", F.lit(elements))
    part = F.pmod(F.xxhash64("value", F.lit(seed + 1)), F.lit(splits))
    each = sizing.divide_and_ceil(elements, splits)
    base = sizing.bin_size_in_bits(fpr, functions, each)
    corrected = -(-int(base * sizing.fpr_correction(fpr, functions, splits)[splits] * 1_000_000) // 1_000_000)
    out = None
    for variant, bins, size in (
        ("single", 1, sizing.bin_size_in_bits(fpr, functions, elements)),
        ("split", splits, base),
        ("split_corrected", splits, corrected),
    ):
        owner = F.lit(0).cast("bigint") if bins == 1 else part
        rows = order.select(owner.alias("user_bin_id"), "value")
        got = _rate(spark, rows, universe, bins, size, functions, chosen).select(
            F.lit(variant).alias("variant"),
            F.lit(size).alias("bin_size"),
            "false_positives",
            "asked",
            F.round(F.col("false_positives") / F.col("asked"), 6).alias("rate"),
        )
        out = got if out is None else out.unionByName(got)
    return out


def hash_collisions(
    spark: SparkSession, elements: int = 1000, repetitions: int = 8, fpr: float = 0.05, functions: int = 2, seed: int = 1
) -> DataFrame:
    """One row: collisions (values that set no new bit) over repetitions, and two estimates of them.

    Each repetition is a bin of one filter and holds ``elements`` hashes of its
    own. The variance of a single repetition is NaN.
    """
    size = sizing.bin_size_in_bits(fpr, functions, elements)
    rows = spark.range(elements * repetitions).select(
        F.floor(F.col("id") / elements).cast("bigint").alias("user_bin_id"), F.xxhash64("id", F.lit(seed)).alias("value")
    )
    index = flat.build(rows, repetitions, size, functions, track_occupancy=True)
    lost = index.occupancy.select((F.lit(elements) - F.col("occupancy")).alias("c"))
    exact = sum(sizing.theoretical_fpr(size, functions, i) for i in range(elements))
    rough = elements * sizing.theoretical_fpr(size, functions, elements) / 2
    return lost.agg(
        F.min("c").alias("min_collisions"),
        F.max("c").alias("max_collisions"),
        F.round(F.avg("c"), 6).alias("mean_collisions"),
        F.coalesce(F.round(F.var_samp("c"), 6), F.lit(float("nan"))).alias("variance"),
    ).select("*", F.lit(size).alias("bin_size"), F.lit(round(exact, 6)).alias("expected"), F.lit(round(rough, 6)).alias("rough"))
