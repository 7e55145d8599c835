"""Per-key results when a few keys hold most rows (problem 5).

Rows that are equal in all columns of interest are combined first. Spark does
so before the shuffle too, hence a key whose rows are mostly one value, or
mostly null, comes down to a few rows. What is left, distinct rows, is then
aggregated in two stages: a key that is *hot*, having more than ``hot_rows`` of
them, gets ``ceil(rows / hot_rows)`` salts, every other key one; partial results
are computed per (key, salt) and merged by key. There can be at most
``total / hot_rows`` hot keys, so the table of them has a bound that does not
grow with the number of keys.

A salt is a seeded hash, not a random number drawn anew: a task that is run again
after a lost executor must put each row where it was before. It is random over
the values of a key; all rows of one value have one salt, so distinct counts of
the salts add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom.session import parallelism, scratch, written

SALT = "__salt"
_SEED = 20240501


def salted(df: DataFrame, key: str, by: list[str], hot_rows: int | None = None) -> DataFrame:
    """``df`` with a column ``__salt``, of which each hot key has several values.

    Null keys are a key of their own. ``hot_rows`` defaults to an eighth of a
    shuffle partition's share, so no salted piece is much longer than another.
    """
    spark = df.sparkSession
    with scratch(spark) as keep:
        counts = written(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")), "counts")
        total = counts.agg(F.sum("__n")).first()[0] or 0
        if hot_rows is None:
            hot_rows = max(4096, total // (8 * parallelism(spark)))
        hot = counts.filter(F.col("__n") > hot_rows).select(
            "__key", F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__salts")
        )
        hot = keep(written(hot, "hot", 1))
    # At most total / hot_rows rows by construction; broadcast only while that is small.
    side = F.broadcast(hot) if total // max(1, hot_rows) <= 100_000 else hot
    spread = df.join(side, F.col(key).eqNullSafe(F.col("__key")), "left")
    salt = F.pmod(F.xxhash64(F.lit(_SEED), *by), F.coalesce("__salts", F.lit(1)).cast("bigint")).cast("int")
    return spread.withColumn(SALT, salt).drop("__key", "__salts")


def salted_aggregate(
    df: DataFrame,
    key: str,
    by: list[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Aggregate ``df`` by ``key`` in two stages.

    ``partial`` names the aggregates per (key, salt), ``merge`` those over the
    partial results per key.
    """
    pieces = salted(df, key, by, hot_rows).groupBy(key, SALT)
    return (
        pieces.agg(*[c.alias(n) for n, c in partial.items()])
        .groupBy(key)
        .agg(*[c.alias(n) for n, c in merge.items()])
    )


def bin_profile(bins: DataFrame, capacities: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(user_bin_id, n_rows, kmer_counts, n_batches, n_tbs) of every user bin.

    ``kmer_counts`` is the number of distinct values over all batches; ``n_tbs``
    is the number of technical bins the user bin needs, one for each
    ``tb_capacity`` begun of its distinct values in a batch, summed over its
    batches. Null values count as rows but not as values; a null user bin is
    one of its own; a batch without a capacity needs none. An empty table gives
    no rows. Other columns are ignored.
    """
    once = written(
        bins.groupBy("user_bin_id", "batch_id", "value").agg(F.count(F.lit(1)).alias("n")), "once"
    )
    pieces = salted(once, "user_bin_id", ["value"], hot_rows)
    per_batch = (
        pieces.groupBy("user_bin_id", SALT, "batch_id")
        .agg(F.sum("n").alias("n"), F.count("value").alias("d"))
        .groupBy("user_bin_id", "batch_id")
        .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    )
    # A value counts once for the whole bin, in however many batches it is.
    whole = (
        pieces.filter(F.col("value").isNotNull())
        .select("user_bin_id", SALT, "value")
        .distinct()
        .groupBy("user_bin_id", SALT)
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy(F.col("user_bin_id").alias("__bin"))
        .agg(F.sum("k").alias("k"))
    )
    caps = capacities.groupBy(F.col("batch_id").alias("__batch")).agg(F.max("tb_capacity").alias("cap"))
    needs = (
        per_batch.join(caps, F.col("batch_id") == F.col("__batch"), "left")
        .groupBy("user_bin_id")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count("batch_id").alias("n_batches"),
            F.coalesce(F.sum(F.ceil(F.col("d") / F.col("cap"))), F.lit(0)).cast("bigint").alias("n_tbs"),
        )
    )
    return needs.join(whole, F.col("user_bin_id").eqNullSafe(F.col("__bin")), "left").select(
        "user_bin_id", "n_rows", F.coalesce("k", F.lit(0)).alias("kmer_counts"), "n_batches", "n_tbs"
    )


def heavy_bins(profile: DataFrame, share: float = 0.04) -> DataFrame:
    """The user bins of ``profile`` that hold at least ``share`` of all its rows."""
    total = profile.agg(F.sum("n_rows").alias("__total"))
    return (
        profile.crossJoin(F.broadcast(total))  # one row by construction
        .filter(F.col("user_bin_id").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("__total")))
        .select("user_bin_id")
    )
