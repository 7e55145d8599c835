"""Hashes, sizes, bit and counter algebra, k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.functions import bits, hashing, sizing
from binloom.operators import flat
from binloom.plans.common import TWO64, GOLDEN, hashed, signed, supplier_parts, unsigned
from binloom.session import table

_SIZE = 7903


def hash_positions(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("value"))
    return hashing.positions(parts, "value", F.lit(_SIZE), F.lit(sizing.hash_shift(_SIZE)), 5).select("value", "fn", "pos")


def hash_wide_values(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "queries").filter("value IS NOT NULL").select("value").distinct()
    return hashing.wy(values, "value")


def bin_size_bits(spark: SparkSession, d: str) -> DataFrame:
    counts = flat.exact_counts(supplier_parts(spark, d))
    return counts.select("user_bin_id", "cardinality", sizing.bin_size_in_bits_of(F.col("cardinality"), 0.05, 2).alias("bits"))


def fpr_correction(spark: SparkSession, d: str) -> DataFrame:
    rows = [(s, round(float(c), 6)) for s, c in enumerate(sizing.fpr_correction(0.01, 5, 256)) if s]
    return spark.createDataFrame(rows, "splits bigint, correction double")


def relaxed_correction(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(sizing.relaxed_fpr_correction(0.05, 0.3, 2), 9),)], "correction double")


def size_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        sizing.next_multiple_of_64_of(n).alias("next_64"),
        sizing.divide_and_ceil_of(n, 7).alias("divided"),
        sizing.subtract_empty_bins_of(n, 0.1).alias("less_empty"),
    )


def _orders(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), c)
    return (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.bit_or(bit((F.col("l_partkey") % 63).cast("int"))).alias("a"),
            F.bit_or(bit((F.col("l_suppkey") % 63).cast("int"))).alias("b"),
        )
        .select("l_orderkey", F.array("a", "b").alias("x"), F.array("b", "a").alias("y"))
    )


def bit_algebra(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    first = lambda c: F.element_at(c, 1)
    return _orders(spark, d).select(
        "l_orderkey",
        first(bits.bit_and(x, y)).alias("both"),
        first(bits.bit_or(x, y)).alias("either"),
        first(bits.bit_xor(x, y)).alias("one"),
        first(bits.bit_and_not(x, y)).alias("first_only"),
        first(bits.bit_not(x)).alias("others"),
        first(bits.flip(x, 5)).alias("flipped"),
        F.element_at(bits.push_back(bits.resize(x, 100), 100, True), 2).alias("pushed"),
        F.element_at(bits.bit_or(bits.resize(x, 100), bits.assigned(100, True)), 2).alias("assigned"),
        bits.get(x, 70).alias("bit_70"),
        bits.bit_count(x).cast("bigint").alias("n_bits"),
        bits.any_set(x).alias("any_bit"),
        bits.none_set(x).alias("no_bit"),
        bits.all_set(x).alias("all_bits"),
    )


def counting_algebra(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_linenumber").alias("a"), F.count(F.lit(1)).alias("b"), F.max("l_suppkey").alias("w"))
    )
    x, y = F.array("a", "b"), F.array("b", "a")
    return rows.select(
        "l_orderkey",
        bits.shown(bits.counting_add(x, y)).alias("added"),
        bits.shown(bits.counting_subtract(x, y)).alias("subtracted"),
        bits.shown(bits.counting_add_bits(x, F.array("w"))).alias("with_bits"),
        bits.shown(bits.counting_subtract_bits(x, F.array("w"))).alias("without_bits"),
    )


def kmer_values(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return hashing.code_point_pairs(documents, "doc_id", "text").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


def sequences_of(df: DataFrame, key: str, copies: int = 1) -> DataFrame:
    """(key, text): a nucleotide sequence for each key, from the digits of its checksum, with an N now and then."""
    digits = F.concat(*[F.md5(F.concat(F.lit("x" * i), F.col(key).cast("string"))) for i in range(copies)])
    return df.select(key, F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGN").alias("text"))


def kmer_bases(spark: SparkSession, d: str) -> DataFrame:
    return hashing.kmers(sequences_of(table(spark, d, "part"), "p_partkey"), "p_partkey", "text", 6)


QUERIES = {
    f.__name__: f
    for f in (hash_positions, hash_wide_values, bin_size_bits, fpr_correction, relaxed_correction, size_arithmetic, bit_algebra, counting_algebra, kmer_values, kmer_bases)
}

#: kmer(key, i, v): the k-mers at place i of the sequences of ``source`` (key, text).
KMERS = """
    spot AS (SELECT key, text, unnest(generate_series(1, length(text) - {k} + 1))::BIGINT AS i FROM {source}),
    cut AS (SELECT key, i, translate(substr(text, i, {k}), 'ACGT', '0123') AS w FROM spot),
    kmer AS (SELECT key, i, list_reduce([0::BIGINT] || list_transform(string_split(w, ''), lambda c: c::BIGINT), lambda a, c: a * 4 + c) AS v FROM cut WHERE NOT contains(w, 'N'))
"""
SEQUENCE = "translate({digits}, '0123456789abcdef', 'ACGTACGTACGTACGN')"

SQL = {
    "kmer_bases": f"""
        WITH s AS (SELECT p_partkey AS key, {SEQUENCE.format(digits="md5(p_partkey::VARCHAR)")} AS text FROM part), {KMERS.format(k=6, source="s")}
        SELECT key AS p_partkey, v AS value FROM kmer
    """,
    "hash_positions": f"""
        WITH given AS (SELECT p_partkey AS v FROM part), {hashed("given", f"SELECT {_SIZE}::BIGINT", 5)}
        SELECT v AS value, fn::INT AS fn, pos FROM pos
    """,
    "hash_wide_values": f"""
        SELECT v AS value, {signed("w")} AS wy
        FROM (SELECT v, xor(p % {TWO64}, p // {TWO64}) AS w
              FROM (SELECT value AS v, {unsigned("value")} * {GOLDEN} AS p FROM (SELECT DISTINCT value FROM queries WHERE value IS NOT NULL)))
    """,
    "bin_size_bits": """
        SELECT l_suppkey AS user_bin_id, count(DISTINCT l_partkey) AS cardinality,
               ceil(-(count(DISTINCT l_partkey) * 2) / ln(1 - exp(ln(0.05::DOUBLE) / 2)))::BIGINT AS bits
        FROM lineitem GROUP BY 1
    """,
    "fpr_correction": """
        WITH s AS (SELECT unnest(generate_series(1, 256)) AS s)
        SELECT s::BIGINT AS splits, round(CASE WHEN s = 1 THEN 1.0::DOUBLE ELSE
            ln(1 - exp(ln(0.01::DOUBLE) / 5)) / ln(1 - exp(ln(1 - exp(ln(1 - 0.01::DOUBLE) / s)) / 5)) END, 6) AS correction FROM s
    """,
    "relaxed_correction": "SELECT round(ln(1 - exp(ln(0.05::DOUBLE) / 2)) / ln(1 - exp(ln(0.3::DOUBLE) / 2)), 9) AS correction",
    "size_arithmetic": """
        SELECT p_partkey, (p_partkey + 63) // 64 * 64 AS next_64, (p_partkey + 6) // 7 AS divided,
               (CASE WHEN p_partkey <= 2 THEN p_partkey ELSE p_partkey - least(greatest(floor(p_partkey * 0.1::DOUBLE)::BIGINT, 1), p_partkey - 2) END)::BIGINT AS less_empty
        FROM part
    """,
    "bit_algebra": """
        WITH o AS (SELECT l_orderkey, bit_or(1::BIGINT << (l_partkey % 63)) AS a, bit_or(1::BIGINT << (l_suppkey % 63)) AS b FROM lineitem GROUP BY 1)
        SELECT l_orderkey, a & b AS both, a | b AS either, xor(a, b) AS one, a & ~b AS first_only, ~a AS others, xor(a, 32::BIGINT) AS flipped,
               (b & 68719476735) | 68719476736 AS pushed, 68719476735 AS assigned, (b >> 6) & 1 = 1 AS bit_70, (bit_count(a) + bit_count(b))::BIGINT AS n_bits, a <> 0 OR b <> 0 AS any_bit, a = 0 AND b = 0 AS no_bit, a = -1 AND b = -1 AS all_bits FROM o
    """,
    "counting_algebra": """
        WITH o AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS a, count(*) AS b, max(l_suppkey) AS w FROM lineitem GROUP BY 1)
        SELECT l_orderkey, '[' || (a + b) || ',' || (b + a) || ']' AS added, '[' || (a - b) || ',' || (b - a) || ']' AS subtracted,
               '[' || (a + (w & 1)) || ',' || (b + ((w >> 1) & 1)) || ']' AS with_bits,
               '[' || (a - (w & 1)) || ',' || (b - ((w >> 1) & 1)) || ']' AS without_bits FROM o
    """,
    "kmer_values": """
        WITH c AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 1)) AS i FROM documents WHERE length(text) >= 2)
        SELECT doc_id, (4 * unicode(substr(text, i::BIGINT, 1)) + unicode(substr(text, i::BIGINT + 1, 1)))::BIGINT AS value, count(*) AS n FROM c GROUP BY 1, 2
    """,
}
