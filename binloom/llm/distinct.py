"""Distinct counts over huge identifier sets (problem 2).

Multiresolution bitmaps. A value's hash picks a level, level ``i`` with
probability ``2^-(i+1)``, and one of ``BITS`` bits of that level's small bitmap.
Bitmaps of parts are united by OR, so partial results per batch can be kept and
merged in any order and repeated rows never count twice. An estimate leaves out
the levels that are saturated and scales up what linear counting gives for the
others, which makes the relative error the same at every size.

A sketch is kept as its non-zero 64-bit words, one row each, so building and
uniting are plain ``bit_or`` aggregations with map-side partial results: a hot
day or group is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one level's bitmap. 4096 give a standard error of about 1.3 %.
BITS = 4096
#: Levels; the last takes all that is left, so about BITS * 2^31 values can be told.
LEVELS = 32
#: A level with a larger part of its bits set is saturated.
SATURATED = 0.9
#: Standard errors in the stated bound.
SIGMAS = 3.0

_WORDS = BITS // 64


def partials(bins: DataFrame) -> DataFrame:
    """(batch_id, day, sample_group, slot, word): the sketches of each batch's parts.

    ``day`` is the date of ``seen_at`` as text; a null ``seen_at`` is a day of
    its own. Spellings of ``sample_group`` that differ in case and surrounding
    blanks are one; null is a group of its own. Null values are not counted.
    """
    h = F.xxhash64("value")
    level = F.lit(LEVELS) - F.length(F.bin(F.shiftrightunsigned(h, 32)))
    at = h.bitwiseAND(F.lit(BITS - 1).cast("bigint")).cast("int")
    return (
        bins.filter(F.col("value").isNotNull())
        .select(
            "batch_id",
            F.date_format("seen_at", "yyyy-MM-dd").alias("day"),
            F.lower(F.trim("sample_group")).alias("sample_group"),
            (level * F.lit(_WORDS) + F.shiftright(at, 6)).cast("int").alias("slot"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), at % F.lit(64)).alias("bit"),
        )
        .groupBy("batch_id", "day", "sample_group", "slot")
        .agg(F.bit_or("bit").alias("word"))
    )


def united(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of the unions by ``keys``."""
    return sketches.groupBy(*keys, "slot").agg(F.bit_or("word").alias("word"))


def estimates(sketches: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``estimate`` and ``rel_error``: a bound of three standard errors, relative.

    At most LEVELS numbers per key leave the first aggregation.
    """
    levels = (
        sketches.groupBy(*keys, F.floor(F.col("slot") / F.lit(_WORDS)).cast("int").alias("level"))
        .agg(F.sum(F.bit_count("word")).alias("ones"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("level", "ones"))).alias("levels"))
    )
    full = F.transform(F.filter("levels", lambda x: x["ones"] > SATURATED * BITS), lambda x: x["level"])
    base = levels.withColumn("base", F.least(F.coalesce(F.array_max(full) + 1, F.lit(0)), F.lit(LEVELS - 1)))
    # A last level that is full itself is counted as if one bit were free.
    load = lambda x: -F.ln(F.greatest(F.lit(BITS) - x["ones"], F.lit(1)) / F.lit(float(BITS)))
    loads = F.transform(F.filter("levels", lambda x: x["level"] >= F.col("base")), load)
    sums = base.withColumn("loads", loads).select(
        *keys,
        F.pow(F.lit(2.0), "base").alias("scale"),
        (F.lit(float(BITS)) * F.aggregate("loads", F.lit(0.0), lambda s, t: s + t)).alias("m"),
        (F.lit(float(BITS)) * F.aggregate("loads", F.lit(0.0), lambda s, t: s + F.exp(t) - t - 1)).alias("v"),
    )
    error = F.sqrt(F.col("v") + F.col("m") * (1 - 1 / F.col("scale"))) / F.greatest("m", F.lit(1.0))
    return sums.select(
        *keys,
        F.round(F.col("scale") * F.col("m")).cast("bigint").alias("estimate"),
        F.round(F.lit(SIGMAS) * error, 6).alias("rel_error"),
    )


def distinct_counts(sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """(scope, day, sample_group, set_id, estimate, rel_error) from partial sketches.

    Scope keys are text. Scopes: each ``day``, each ``group``, each ``set`` of groups, each
    ``day_group`` and each ``day_set``. Columns that are no part of the scope
    are null. A set member that no row has adds nothing; a set without any row
    gives none. Empty tables give no rows.
    """
    cells = united(sketches, "day", "sample_group")
    members = sets.filter(F.col("sample_group").isNotNull()).select(
        "set_id", F.lower(F.trim("sample_group")).alias("sample_group")
    ).distinct()
    in_sets = cells.join(members, "sample_group")
    scopes = {
        "day": (cells, ["day"]),
        "group": (cells, ["sample_group"]),
        "set": (in_sets, ["set_id"]),
        "day_group": (cells, ["day", "sample_group"]),
        "day_set": (in_sets, ["day", "set_id"]),
    }
    out = None
    kinds = dict.fromkeys(("day", "sample_group", "set_id"), "string")
    for scope, (source, keys) in scopes.items():
        rows = estimates(united(source, *keys), *keys).select(
            F.lit(scope).alias("scope"),
            *[(F.col(c) if c in keys else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()],
            "estimate",
            "rel_error",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def exact_counts(bins: DataFrame, sets: DataFrame) -> DataFrame:
    """(scope, day, sample_group, set_id, exact): what :func:`distinct_counts` estimates, counted value by value."""
    cells = (
        bins.filter(F.col("value").isNotNull())
        .select(F.date_format("seen_at", "yyyy-MM-dd").alias("day"), F.lower(F.trim("sample_group")).alias("sample_group"), "value")
        .distinct()
    )
    members = sets.filter(F.col("sample_group").isNotNull()).select(
        "set_id", F.lower(F.trim("sample_group")).alias("sample_group")
    ).distinct()
    in_sets = cells.join(members, "sample_group")
    scopes = {
        "day": (cells, ["day"]),
        "group": (cells, ["sample_group"]),
        "set": (in_sets, ["set_id"]),
        "day_group": (cells, ["day", "sample_group"]),
        "day_set": (in_sets, ["day", "set_id"]),
    }
    out = None
    for scope, (source, keys) in scopes.items():
        once = source.select(*keys, "value").distinct()
        rows = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("exact")).select(
            F.lit(scope).alias("scope"), *[(F.col(c) if c in keys else F.lit(None)).cast("string").alias(c) for c in ("day", "sample_group", "set_id")], "exact"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def kept_bounds(told: DataFrame, exact: DataFrame) -> DataFrame:
    """(scope, n, total, kept): per scope the exact counts, their sum, and whether estimates keep their bound.

    A bound of three standard errors is left by 3 in 1,000 on average; it counts
    as kept when 99 in 100 of a scope's estimates are within it, but for two.
    """
    both = exact.join(told, [exact[c].eqNullSafe(told[c]) for c in ("scope", "day", "sample_group", "set_id")], "left")
    off = F.abs(F.col("estimate") - F.col("exact")) > F.greatest(F.lit(1.0), F.col("rel_error") * F.col("exact"))
    return both.groupBy(exact["scope"]).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("exact").alias("total"),
        (F.count_if(F.coalesce(off, F.lit(True))) <= F.greatest(F.lit(2.0), F.count(F.lit(1)) * 0.01)).alias("kept"),
    )
