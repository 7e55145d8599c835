"""Cardinality and similarity sketches of user bins.

A register sketch keeps, for each of ``2^bits`` registers, the highest rank seen;
as rows it holds only registers that are not zero, so building and merging are
``max`` aggregations with map-side partial results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.functions import hashing
from binloom.operators import arrange

#: Registers and values per register of a MinHash table.
MINHASH_TABLES = 16
MINHASH_VALUES = 40


def check_bits(bits: int) -> None:
    if not 5 <= bits <= 32:
        raise ValueError(f"sketch bits must be in [5,32], not {bits}")


def registers(bins: DataFrame, bits: int = 12, *keys: str, value: str = "value") -> DataFrame:
    """(keys, register, rank) of each key's values; by default per ``user_bin_id``.

    Null values are none.
    """
    check_bits(bits)
    keys = keys or ("user_bin_id",)
    hashed = hashing.wy(bins.filter(F.col(value).isNotNull()).select(*keys, value), value, "__wy")
    register = F.shiftrightunsigned("__wy", 64 - bits).cast("int")
    # A bit below the shifted hash ends every run of zeros.
    rest = F.shiftleft("__wy", bits).bitwiseOR(F.lit(1 << (bits - 1)).cast("bigint"))
    rank = F.lit(65) - F.length(F.bin(rest))
    return (
        hashed.select(*keys, register.alias("register"), rank.alias("rank"))
        .groupBy(*keys, "register")
        .agg(F.max("rank").alias("rank"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of the unions by ``keys``."""
    return sketches.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def norm(bits: int) -> float:
    m = 1 << bits
    alpha = {32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    return alpha * m * m


def estimate(sketches: DataFrame, bits: int, *keys: str, out: str = "estimate") -> DataFrame:
    """(keys, out): estimated distinct values; registers without a row are zero."""
    keys = keys or ("user_bin_id",)
    m = 1 << bits
    sums = sketches.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("__s"), F.count(F.lit(1)).alias("__k"))
    zeros = F.lit(m) - F.col("__k")
    raw = F.lit(norm(bits)) / (F.col("__s") + zeros)
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / zeros)
    return sums.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw).alias(out))


def counts(sketches: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, kmer_counts): estimates cut to whole numbers."""
    keys = keys or ("user_bin_id",)
    return estimate(sketches, bits, *keys).select(*keys, F.floor("estimate").cast("bigint").alias("kmer_counts"))


def np_registers(values: np.ndarray, bits: int) -> np.ndarray:
    """The registers of one set, as an array of bytes."""
    check_bits(bits)
    h = hashing.np_wy(np.asarray(values, np.uint64))
    rest = (h << np.uint64(bits)) | np.uint64(1 << (bits - 1))
    low = (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (rest >> np.uint64(32)).astype(np.float64)
    length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    out = np.zeros(1 << bits, np.uint8)
    np.maximum.at(out, (h >> np.uint64(64 - bits)).astype(np.int64), (65 - length).astype(np.uint8))
    return out


def np_estimate(registers_: np.ndarray) -> float:
    """The estimate with sums in single precision over eight lanes, as stored sketches expect."""
    m = len(registers_)
    bits = m.bit_length() - 1
    terms = np.exp2(-registers_.astype(np.float32)).astype(np.float32).reshape(-1, 8)
    # Running sums add in the given order, each time in single precision.
    lanes = np.add.accumulate(terms, axis=0, dtype=np.float32)[-1]
    total = np.add.accumulate(lanes, dtype=np.float32)[-1]
    value = norm(bits) / float(total)
    zeros = int(np.count_nonzero(registers_ == 0))
    return m * math.log(m / zeros) if value <= 2.5 * m and zeros else value


def store(sketches: DataFrame, bits: int, key: str = "user_bin_id", out: str = "sketch") -> DataFrame:
    """(key, out BINARY): one byte with the register width, then one byte per register.

    A group is at most ``2^bits`` rows.
    """
    packed = sketches.groupBy(key).agg(F.collect_list(F.struct("register", "rank")).alias("r"))
    schema = pa.schema([(key, pa.int64()), (out, pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entries in batch.column("r").to_pylist():
                line = np.zeros(1 << bits, np.uint8)
                for e in entries:
                    line[e["register"]] = e["rank"]
                rows.append(bytes([bits]) + line.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, pa.binary())], schema=schema)

    return packed.mapInArrow(pack, f"{key} bigint, {out} binary")


def load(stored: DataFrame, key: str = "user_bin_id", column: str = "sketch") -> DataFrame:
    """(key, register, rank) from stored sketches; null sketches are left out, broken ones an error."""
    schema = pa.schema([(key, pa.int64()), ("register", pa.int32()), ("rank", pa.int32())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, raw in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist()):
                if not raw or not 5 <= raw[0] <= 32 or len(raw) != 1 + (1 << raw[0]):
                    raise ValueError(f"not a stored sketch: {len(raw or b'')} bytes")
                line = np.frombuffer(raw, np.uint8, offset=1)
                at = np.flatnonzero(line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), owner)), pa.array(at.astype(np.int32)), pa.array(line[at].astype(np.int32))],
                    schema=schema,
                )

    return stored.filter(F.col(column).isNotNull()).select(key, column).mapInArrow(unpack, f"{key} bigint, register int, rank int")


def prefix_union_estimates(sketches: DataFrame, order: DataFrame, bits: int) -> DataFrame:
    """(position, union_estimates): distinct values of the bins at positions 0 to ``position``.

    ``order`` is (user_bin_id, position). A running maximum per register finds
    where a register rises; the estimate needs only the number of registers of
    each rank, which is summed over those rises.
    """
    m = 1 << bits
    ranked = sketches.join(order, "user_bin_id")
    upto = Window.partitionBy("register").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rises = ranked.withColumn("before", F.coalesce(F.max("rank").over(upto), F.lit(0))).filter(F.col("rank") > F.col("before"))
    change = rises.groupBy("position").agg(
        F.sum(F.pow(F.lit(2.0), -F.col("rank")) - F.pow(F.lit(2.0), -F.col("before"))).alias("ds"),
        F.count_if(F.col("before") == 0).alias("dz"),
    )
    change = order.select("position").join(change, "position", "left").select(
        "position", F.coalesce("ds", F.lit(0.0)).alias("ds"), F.coalesce("dz", F.lit(0)).cast("bigint").alias("dz")
    )
    sums = arrange.running_sums(change, "position", ["ds", "dz"]).select(
        "position", (F.lit(float(m)) + F.col("ds")).alias("s"), (F.lit(m) - F.col("dz")).alias("z")
    )
    raw = F.lit(norm(bits)) / F.col("s")
    value = F.when((raw <= 2.5 * m) & (F.col("z") > 0), F.lit(float(m)) * F.ln(F.lit(float(m)) / F.col("z"))).otherwise(raw)
    return sums.select("position", F.floor(value).cast("bigint").alias("union_estimates"))


def minhash(bins: DataFrame, key: str = "user_bin_id", value: str = "value") -> DataFrame:
    """(key, register, rn, hash): for each of 16 registers the 40 smallest values, less their low four bits.

    Spark drops all but the first 40 of each group before the shuffle.
    """
    x = bins.filter(F.col(value).isNotNull()).select(key, value).distinct()
    x = x.withColumn("register", F.col(value).bitwiseAND(F.lit(MINHASH_TABLES - 1).cast("bigint")).cast("int"))
    w = Window.partitionBy(key, "register").orderBy(hashing.unsigned_order(F.col(value)))
    return (
        x.withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= MINHASH_VALUES)
        .select(key, "register", (F.col("rn") - 1).alias("rn"), F.shiftrightunsigned(value, 4).alias("hash"))
    )


def minhash_valid(table: DataFrame, key: str = "user_bin_id") -> DataFrame:
    """(key, is_valid): whether all registers are full."""
    return table.groupBy(key).agg((F.count(F.lit(1)) == MINHASH_TABLES * MINHASH_VALUES).alias("is_valid"))


def minhash_strict(bins: DataFrame, key: str = "user_bin_id", value: str = "value") -> DataFrame:
    """As :func:`minhash`; a bin with too few values is an error when the result is computed."""
    table = minhash(bins, key, value)
    sizes = table.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    need = MINHASH_TABLES * MINHASH_VALUES
    message = F.concat(F.lit("Not enough values ("), F.col("__n").cast("string"), F.lit(f") to get {need} hashes"))
    checked = sizes.withColumn("__ok", F.when(F.col("__n") < need, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return table.join(checked.filter("__ok"), F.col(key) == F.col("__k")).drop("__k", "__n", "__ok")


def minhash_similarity(table: DataFrame, key: str = "user_bin_id") -> Column:
    """Estimated Jaccard similarity is the share of equal entries of two tables; a helper for joins on (register, hash)."""
    return F.count(F.lit(1)) / F.lit(MINHASH_TABLES * MINHASH_VALUES)
