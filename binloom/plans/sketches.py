"""Cardinalities, register sketches, MinHash tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import arrange, flat, sketch
from binloom.plans.common import GOLDEN, TWO64, supplier_parts, unsigned
from binloom.session import table, written

_BITS = 10


def bin_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return flat.exact_counts(table(spark, d, "bins").filter("user_bin_id IS NOT NULL"))


def largest_bin(spark: SparkSession, d: str) -> DataFrame:
    rows = sketch.registers(table(spark, d, "bins").filter("user_bin_id IS NOT NULL"), _BITS)
    return flat.fullest(sketch.estimate(rows, _BITS)).select("user_bin_id", F.round("estimate", 4).alias("estimate"))


def hll_registers(spark: SparkSession, d: str) -> DataFrame:
    return sketch.registers(table(spark, d, "bins").filter("user_bin_id IS NOT NULL"), _BITS)


def hll_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = hll_registers(spark, d)
    return sketch.estimate(rows, _BITS).select("user_bin_id", F.round("estimate", 4).alias("estimate"))


def hll_counts(spark: SparkSession, d: str) -> DataFrame:
    return sketch.counts(hll_registers(spark, d), _BITS)


def hll_union_by_batch(spark: SparkSession, d: str) -> DataFrame:
    parts = sketch.registers(table(spark, d, "bins").filter("batch_id IS NOT NULL"), _BITS, "batch_id", "user_bin_id")
    return sketch.estimate(sketch.merged(parts, "batch_id"), _BITS, "batch_id").select("batch_id", F.round("estimate", 4).alias("estimate"))


def hll_stored(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of the stored sketches, each row of the workspace once."""
    stored = (
        table(spark, d, "data_store")
        .filter("sketches IS NOT NULL")
        .groupBy("user_bin_id", "batch_id")
        .agg(F.first("sketches").alias("sketch"))
    )
    # A number for each pair of keys, whatever the keys are.
    keys = written(arrange.ranked(stored, [], [F.col("batch_id"), F.col("user_bin_id")], "row"), "rows")
    rows = sketch.load(keys, "row", "sketch")
    return sketch.estimate(rows, _BITS, "row").join(keys, "row").select("user_bin_id", "batch_id", F.round("estimate", 4).alias("estimate"))


def prefix_union_estimates(spark: SparkSession, d: str) -> DataFrame:
    values = supplier_parts(spark, d)
    order = written(arrange.sorted_bins(flat.exact_counts(values)), "order").select("user_bin_id", "position")
    return sketch.prefix_union_estimates(sketch.registers(values, 12), order, 12)


def minhash_table(spark: SparkSession, d: str) -> DataFrame:
    return sketch.minhash(table(spark, d, "bins").filter("user_bin_id IS NOT NULL"))


def minhash_valid(spark: SparkSession, d: str) -> DataFrame:
    return sketch.minhash_valid(minhash_table(spark, d))


def sketch_built_in(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own sketches, for results that need not match stored ones: exact counts, and whether estimates are within 10 %."""
    bins = table(spark, d, "bins").filter("user_bin_id IS NOT NULL")
    parts = bins.groupBy("user_bin_id", "batch_id").agg(F.hll_sketch_agg("value", F.lit(12)).alias("s"))
    told = parts.groupBy("user_bin_id").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("estimate"))
    exact = flat.exact_counts(bins)
    near = F.abs(F.col("estimate") - F.col("cardinality")) <= F.greatest(F.lit(1.0), F.col("cardinality") * 0.1)
    return told.join(exact, "user_bin_id").select("user_bin_id", "cardinality", near.alias("near"))


QUERIES = {
    f.__name__: f
    for f in (bin_cardinality, largest_bin, hll_registers, hll_estimates, hll_counts, hll_union_by_batch, hll_stored, prefix_union_estimates, minhash_table, minhash_valid, sketch_built_in)
}


def _registers(source: str, keys: str, bits: int) -> str:
    """CTEs that give reg(keys, register, rank) for ``source`` with keys and v."""
    return f"""
        w0 AS (SELECT {keys}, {unsigned("v")} * {GOLDEN} AS p FROM (SELECT DISTINCT {keys}, v FROM {source})),
        w1 AS (SELECT {keys}, xor(p % {TWO64}, p // {TWO64}) AS h FROM w0),
        reg AS (
            SELECT {keys}, (h // {2 ** (64 - bits)})::INT AS register,
                   max(65 - length(bin(((h * {2**bits} % {TWO64}) | {2 ** (bits - 1)}::UHUGEINT)::UBIGINT)))::INT AS rank
            FROM w1 GROUP BY ALL
        )
    """


def _estimate(source: str, keys: str, bits: int) -> str:
    m = 2**bits
    norm = sketch.norm(bits)
    return f"""
        SELECT {keys}, CASE WHEN raw <= 2.5 * {m} AND z > 0 THEN {m}::DOUBLE * ln({m}::DOUBLE / z) ELSE raw END AS estimate
        FROM (SELECT {keys}, {norm!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -rank)) + {m} - count(*)) AS raw, {m} - count(*) AS z FROM {source} GROUP BY {keys})
    """


_BIN_VALUES = "given AS (SELECT user_bin_id, batch_id, value AS v FROM bins WHERE value IS NOT NULL AND user_bin_id IS NOT NULL)"
_ALL = f"{_BIN_VALUES}, {_registers('given', 'user_bin_id', _BITS)}"
_MINHASH = """
    SELECT user_bin_id, register::INT AS register, (rn - 1)::INT AS rn, (u // 16)::BIGINT AS hash
    FROM (SELECT user_bin_id, u % 16 AS register, u, row_number() OVER (PARTITION BY user_bin_id, u % 16 ORDER BY u) AS rn
          FROM (SELECT DISTINCT user_bin_id, (CASE WHEN value < 0 THEN value::HUGEINT + 18446744073709551616 ELSE value END)::UHUGEINT AS u
                FROM bins WHERE value IS NOT NULL AND user_bin_id IS NOT NULL)) WHERE rn <= 40
"""

SQL = {
    "bin_cardinality": "SELECT user_bin_id, count(DISTINCT value) AS cardinality FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL GROUP BY 1",
    "hll_registers": f"WITH {_ALL} SELECT * FROM reg",
    "hll_estimates": f"WITH {_ALL} SELECT user_bin_id, round(estimate, 4) AS estimate FROM ({_estimate('reg', 'user_bin_id', _BITS)})",
    "hll_counts": f"WITH {_ALL} SELECT user_bin_id, floor(estimate)::BIGINT AS kmer_counts FROM ({_estimate('reg', 'user_bin_id', _BITS)})",
    "largest_bin": f"WITH {_ALL} SELECT user_bin_id, round(estimate, 4) AS estimate FROM ({_estimate('reg', 'user_bin_id', _BITS)}) ORDER BY estimate DESC, user_bin_id LIMIT 1",
    "hll_union_by_batch": f"""
        WITH given AS (SELECT batch_id, value AS v FROM bins WHERE value IS NOT NULL AND batch_id IS NOT NULL), {_registers('given', 'batch_id', _BITS)}
        SELECT batch_id, round(estimate, 4) AS estimate FROM ({_estimate('reg', 'batch_id', _BITS)})
    """,
    "hll_stored": f"""
        WITH {_BIN_VALUES}, {_registers('given', 'user_bin_id, batch_id', _BITS)}
        SELECT user_bin_id, batch_id, round(estimate, 4) AS estimate FROM ({_estimate('reg', 'user_bin_id, batch_id', _BITS)})
        SEMI JOIN (SELECT user_bin_id, batch_id FROM data_store WHERE sketches IS NOT NULL) USING (user_bin_id, batch_id)
    """,
    "prefix_union_estimates": f"""
        WITH given AS (SELECT l_suppkey AS b, l_partkey AS v FROM lineitem), {_registers('given', 'b', 12)},
        sizes AS (SELECT b, count(DISTINCT v) AS n FROM given GROUP BY 1),
        ord AS (SELECT b, row_number() OVER (ORDER BY n DESC, b) - 1 AS position FROM sizes),
        grown AS (SELECT o.position, r.register, max(r.rank) AS rank FROM ord o JOIN ord p ON p.position <= o.position JOIN reg r ON r.b = p.b GROUP BY 1, 2)
        SELECT position, floor(estimate)::BIGINT AS union_estimates FROM ({_estimate('grown', 'position', 12)})
    """,
    "minhash_table": _MINHASH,
    "minhash_valid": f"SELECT user_bin_id, count(*) = 640 AS is_valid FROM ({_MINHASH}) GROUP BY 1",
}

SQL["sketch_built_in"] = SQL["bin_cardinality"].replace("AS cardinality", "AS cardinality, true AS near")
