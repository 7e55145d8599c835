"""Overlap sizes between many large sets (problem 3).

Candidates come from a bounded number of values of each set. Of a set of ``n``
values those are *probes* whose hash falls below a bound that lets about
``EXPECTED`` of them be shared with a set that has the wanted share; of a small
set all are. Such a set shares ``c`` probes at least: all but never that many for
sampled sets (less than once in 10^9 pairs), and exactly for others. So the
``c / 2`` probes that most sets have need not be looked up, as ``c / 2`` others
must be shared too: a value that very many sets have is in no lookup unless a set
has many such values. Overlaps of the candidates are then counted by galloping
intersection of delta-encoded sorted runs, per pair and range of identifiers, and
summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm import runs
from binloom.session import scratch, written

#: Probes that a set and one with the wanted share of it have in common on average.
EXPECTED = 51.0
#: Standard deviations below the average at which a pair is given up.
SPARE = 6.0
#: Sets of one value that one task pairs with the probes for it.
SPREAD = 1024
_SEED = 77


def candidates(index: DataFrame, share: float) -> DataFrame:
    """(bin, hub): pairs of sets that may share ``share`` of the smaller, as ``bin``.

    ``index`` is (bin, code, n, df): the values that more than one set has,
    with the size of the set and the number of sets of the value.
    """
    least = F.ceil(F.lit(share) * F.col("n") - F.lit(1e-9))
    rate = F.least(F.lit(1.0), F.lit(EXPECTED) / least)
    fraction = F.shiftrightunsigned(F.xxhash64("code", F.lit(_SEED)), 11) / F.lit(float(2**53))
    mean = least * rate
    common = F.when(rate == 1, least).otherwise(F.greatest(F.lit(1), F.ceil(mean - F.lit(SPARE) * F.sqrt(mean))))
    own = Window.partitionBy("bin")  # a set has a few hundred probes at most
    probes = (
        index.withColumn("common", common.cast("bigint"))
        .filter(fraction < rate)
        .withColumns({"place": F.row_number().over(own.orderBy(F.desc("df"), "code")), "probes": F.count(F.lit(1)).over(own)})
        .filter((F.col("probes") >= F.col("common")) & (F.col("place") > F.floor(F.col("common") / 2)))
        .withColumn("need", F.col("common") - F.floor(F.col("common") / 2))
    )
    salts = F.ceil(F.col("df") / F.lit(SPREAD)).cast("int")
    a = probes.select(
        F.col("bin").alias("x"), "code", F.pmod(F.xxhash64("bin"), salts.cast("bigint")).cast("int").alias("salt"), F.col("n").alias("nx"), "need"
    )
    b = index.select(F.col("bin").alias("y"), "code", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("n").alias("ny"))
    return (
        a.join(b, ["code", "salt"])
        .filter(F.struct("nx", "x") < F.struct("ny", "y"))
        .groupBy("x", "y", "need")
        .agg(F.count(F.lit(1)).alias("met"))
        .filter("met >= need")
        .select(F.col("x").alias("bin"), F.col("y").alias("hub"))
    )


def overlaps(bins: DataFrame, least: int = 100, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The sets and the overlaps between them.

    Returns (user_bin_id, rep, n): every set of at least ``least`` distinct
    values with its representative among equal sets; and (bin, hub, shared,
    n_bin, n_hub): the pairs of representatives that share at least ``share``
    of the smaller one's values, the smaller as ``bin``. Equal sets share all
    and are not listed as pairs. Null bins and values are left out, repeated
    rows count once, an empty table gives no rows, other columns are ignored.
    """
    with scratch(bins.sparkSession) as keep:
        codes = written(runs.distinct_codes(bins), "codes")
        sets = keep(written(runs.classes(codes).filter(F.col("n") >= least), "sets"))
        reps = sets.filter("bin = rep").select("bin", "n")
        whole = codes.join(reps, "bin").repartition("code")
        # Values of one set only can be in no overlap; what is left is far smaller.
        df = whole.groupBy("code").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        index = written(whole.join(df, "code").select("bin", "code", "n", "df"), "index")
        pairs = written(candidates(index, share), "pairs")
        used = pairs.select("bin").union(pairs.select("hub")).distinct()
        picked = written(runs.sorted_runs(index.select("bin", "code"), reps.join(used, "bin", "left_semi")), "runs")
        counted = runs.shared_counts(pairs, picked, reps)
        strong = keep(written(counted.filter(F.col("shared") >= F.lit(share) * F.col("n_bin") - F.lit(1e-9)), "strong"))
    return sets.select(F.col("bin").alias("user_bin_id"), "rep", "n"), strong


def strong_pairs(sets: DataFrame, strong: DataFrame) -> DataFrame:
    """(user_bin_a, user_bin_b, shared, n_small), equal sets spread out again."""
    a = sets.select(F.col("user_bin_id").alias("a"), F.col("rep").alias("bin"))
    b = sets.select(F.col("user_bin_id").alias("b"), F.col("rep").alias("hub"))
    between = strong.join(a, "bin").join(b, "hub").select("a", "b", "shared", F.col("n_bin").alias("n_small"))
    same = a.withColumnRenamed("bin", "rep").join(
        sets.select(F.col("user_bin_id").alias("b"), "rep", "n"), "rep"
    ).filter("a < b").select("a", "b", F.col("n").alias("shared"), F.col("n").alias("n_small"))
    return between.unionByName(same).select(
        F.least("a", "b").alias("user_bin_a"), F.greatest("a", "b").alias("user_bin_b"), "shared", "n_small"
    )
