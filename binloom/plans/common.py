"""Inputs of the registered queries, and pieces of SQL they share.

Suppliers are the user bins of the flat filter queries, part keys the values;
a customer's parts are a query. The tree queries use ``bins`` and ``queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import flat
from binloom.session import table

FPR = 0.05
FUNCTIONS = 2


def supplier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_bin_id"), F.col("l_partkey").alias("value"))


def customer_parts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("query_id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("value"))
    return orders.join(lines, "o_orderkey").select("query_id", "value")


def supplier_filter(spark: SparkSession, d: str, track_occupancy: bool = False) -> flat.Filter:
    values = supplier_parts(spark, d)
    bins = (values.agg(F.max("user_bin_id")).first()[0] or 0) + 1
    return flat.build(values, bins, flat.max_bin_size(values, FPR, FUNCTIONS), FUNCTIONS, track_occupancy)


TWO64 = "18446744073709551616"
GOLDEN = "11400714819323198485"
SEEDS = "(VALUES (0, 13572355802537770549::UHUGEINT), (1, 13043817825332782213::UHUGEINT), (2, 10650232656628343401::UHUGEINT), (3, 16499269484942379435::UHUGEINT), (4, 4893150838803335377::UHUGEINT))"


def unsigned(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN {v}::HUGEINT + {TWO64} ELSE {v}::HUGEINT END)::UHUGEINT"


def signed(v: str) -> str:
    return f"(CASE WHEN {v} >= 9223372036854775808 THEN {v}::HUGEINT - {TWO64} ELSE {v}::HUGEINT END)::BIGINT"


def hashed(source: str, size: str, functions: int) -> str:
    """CTEs that give ``pos(v, fn, pos)`` for the values ``v`` of ``source``; ``size`` is a scalar query."""
    return f"""
        seeds AS (SELECT * FROM {SEEDS} t(fn, seed) WHERE fn < {functions}),
        shape AS (SELECT s, (1::UHUGEINT << (64 - length(bin(s)))::UHUGEINT) AS down FROM ({size}) q(s)),
        h1 AS (SELECT v, fn, {unsigned("v")} * seed % {TWO64} AS h FROM (SELECT DISTINCT v FROM {source}) CROSS JOIN seeds),
        h2 AS (SELECT v, fn, xor(h, h // down) * {GOLDEN} % {TWO64} AS h FROM h1 CROSS JOIN shape),
        pos AS (SELECT v, fn, (h * s::UHUGEINT // {TWO64})::BIGINT AS pos FROM h2 CROSS JOIN shape)
    """


SIZE = "SELECT ceil(-(max(n) * 2) / ln(1 - exp(ln(0.05::DOUBLE) / 2)))::BIGINT FROM (SELECT count(*) AS n FROM held GROUP BY b)"

#: held(b, v), the positions of its values, and set(b, pos): the bits of the filter over suppliers.
FILTER = f"""
    held AS (SELECT DISTINCT l_suppkey AS b, l_partkey AS v FROM lineitem),
    {hashed("held", SIZE, 2)},
    bitset AS (SELECT DISTINCT b, pos FROM held JOIN pos USING (v))
"""

#: hit(v, b): the bins that hold all bits of a value.
HITS = f"""
    {FILTER},
    hit AS (SELECT v, b FROM pos JOIN bitset USING (pos) GROUP BY v, b HAVING count(*) = 2)
"""
ASKED = "asked AS (SELECT o_custkey AS q, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
