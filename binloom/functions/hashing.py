"""64-bit hashing in unsigned arithmetic, as column expressions and in NumPy.

Spark has no unsigned 64-bit type and in ANSI mode overflow is an error, so
products are put together from limbs of 22 bits, none of which can overflow.
A product refers to its argument about a dozen times; steps are therefore
columns of their own, which Catalyst keeps apart and computes once, all within
one stage of generated code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The seeds of the filter's hash functions and the multiplier.
SEEDS = (
    13572355802537770549,
    13043817825332782213,
    10650232656628343401,
    16499269484942379435,
    4893150838803335377,
)
GOLDEN = 11400714819323198485

_M22 = (1 << 22) - 1
_M32 = (1 << 32) - 1


def signed(value: int) -> int:
    """The BIGINT with the bit pattern of an unsigned 64-bit number."""
    return value - (1 << 64) if value >= 1 << 63 else value


def _long(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def _shr(c: Column, n) -> Column:
    return F.shiftrightunsigned(c, n) if isinstance(n, int) else F.call_function("shiftrightunsigned", c, n)


def _limbs(x: Column) -> tuple[Column, Column, Column]:
    m = _long(_M22)
    return x.bitwiseAND(m), _shr(x, 22).bitwiseAND(m), _shr(x, 44)


def fit(h: Column, n: Column) -> Column:
    """(h * n) >> 64 for an unsigned h and 0 < n < 2^31."""
    low = _shr(h.bitwiseAND(_long(_M32)) * n, 32)
    return _shr(_shr(h, 32) * n + low, 32)


def positions(df: DataFrame, value: str, bin_size: Column, shift: Column, functions: int) -> DataFrame:
    """``df`` with a row for each of the first ``functions`` hash functions: ``fn``, and ``pos``, the filter row of ``value``.

    ``shift`` is 64 minus the bit length of ``bin_size``; both may be columns.
    Rows with a null in one of the three are dropped. The seed is a column, so
    there is one piece of generated code for all functions.
    """
    seeds = [
        F.struct(
            F.lit(i).alias("fn"), *[_long(s >> at & m).alias(f"b{k}") for k, (at, m) in enumerate(((0, _M22), (22, _M22), (44, _M22)))]
        )
        for i, s in enumerate(SEEDS[:functions])
    ]
    a = _limbs(F.col(value))
    x = df.withColumns({"__n": bin_size.cast("bigint"), "__s": shift, "__a0": a[0], "__a1": a[1], "__a2": a[2]})
    x = x.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("__n", "__s", "__a0")))
    x = x.select("*", F.inline(F.array(*seeds)))
    x = x.withColumn("__t0", F.col("__a0") * F.col("b0"))
    x = x.withColumn("__t1", F.col("__a0") * F.col("b1") + F.col("__a1") * F.col("b0") + _shr(F.col("__t0"), 22))
    x = x.withColumn("__t2", F.col("__a0") * F.col("b2") + F.col("__a1") * F.col("b1") + F.col("__a2") * F.col("b0") + _shr(F.col("__t1"), 22))
    x = x.withColumn("__h", _joined("__t0", "__t1", "__t2"))
    x = x.withColumn("__h", F.col("__h").bitwiseXOR(_shr(F.col("__h"), F.col("__s"))))
    x = _times(x, "__h", GOLDEN)
    # Never null, and seen to be so: else a join on ``pos`` would make Catalyst push a null check, with all
    # these steps folded into one expression, below them.
    return x.withColumn("pos", F.coalesce(fit(F.col("__h"), F.col("__n")), F.lit(-1).cast("bigint"))).drop(
        "__n", "__s", "__a0", "__a1", "__a2", "b0", "b1", "b2", "__t0", "__t1", "__t2", "__h"
    )


def _joined(t0: str, t1: str, t2: str) -> Column:
    m = _long(_M22)
    return F.col(t0).bitwiseAND(m).bitwiseOR(F.shiftleft(F.col(t1).bitwiseAND(m), 22)).bitwiseOR(F.shiftleft(t2, 44))


def _times(df: DataFrame, x: str, factor: int) -> DataFrame:
    """``df`` with the low 64 bits of ``x`` times a constant in place of ``x``."""
    a0, a1, a2 = _limbs(F.col(x))
    b0, b1, b2 = (_long(factor & _M22), _long(factor >> 22 & _M22), _long(factor >> 44))
    df = df.withColumns({"__a0": a0, "__a1": a1, "__a2": a2})
    df = df.withColumn("__t0", F.col("__a0") * b0)
    df = df.withColumn("__t1", F.col("__a0") * b1 + F.col("__a1") * b0 + _shr(F.col("__t0"), 22))
    df = df.withColumn("__t2", F.col("__a0") * b2 + F.col("__a1") * b1 + F.col("__a2") * b0 + _shr(F.col("__t1"), 22))
    return df.withColumn(x, _joined("__t0", "__t1", "__t2"))


def wy(df: DataFrame, value: str, out: str = "wy") -> DataFrame:
    """``df`` with ``out``: the two halves of value * GOLDEN, one XOR the other."""
    df = _times(df.withColumn(out, F.col(value)), out, GOLDEN)
    b1, b2 = _long(GOLDEN >> 22 & _M22), _long(GOLDEN >> 44)
    s3 = F.col("__a1") * b2 + F.col("__a2") * b1
    df = df.withColumn("__u", _shr(F.col("__t2"), 20) + F.shiftleft(s3, 2))
    high = F.shiftleft(F.col("__a2") * b2 + _shr(F.col("__u"), 24), 24).bitwiseOR(F.col("__u").bitwiseAND(_long((1 << 24) - 1)))
    return df.withColumn(out, F.col(out).bitwiseXOR(high)).drop("__a0", "__a1", "__a2", "__t0", "__t1", "__t2", "__u")


def unsigned_order(c: Column) -> Column:
    """Sorts as the unsigned number does."""
    return c.bitwiseXOR(_long(1 << 63))


def np_product_high(x: np.ndarray, factor: int) -> np.ndarray:
    x = x.astype(np.uint64)
    m = np.uint64(_M32)
    s = np.uint64(32)
    a1, a0 = x >> s, x & m
    b1, b0 = np.uint64(factor >> 32), np.uint64(factor & _M32)
    middle = a1 * b0 + ((a0 * b0) >> s)
    other = a0 * b1 + (middle & m)
    return a1 * b1 + (middle >> s) + (other >> s)


def np_wy(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.uint64)
    return np_product_high(v, GOLDEN) ^ (v * np.uint64(GOLDEN))


def np_positions(values: np.ndarray, bin_size: int, functions: int) -> np.ndarray:
    """(functions, len(values)): as :func:`positions`."""
    v = values.astype(np.uint64)
    shift = np.uint64(64 - bin_size.bit_length())
    out = np.empty((functions, len(v)), np.int64)
    for i, seed in enumerate(SEEDS[:functions]):
        h = v * np.uint64(seed)
        h ^= h >> shift
        h *= np.uint64(GOLDEN)
        out[i] = np_product_high(h, bin_size).astype(np.int64)
    return out


#: Two bits a base; all other letters are none.
BASES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
#: Letters of a text that are turned into k-mers at a time.
PIECE = 1 << 20


def np_kmers(text: bytes, k: int) -> np.ndarray:
    """The k-mers of a sequence as numbers of two bits a base, in order; windows with other letters are left out.

    Windows grow by doubling, so the work is the length times the logarithm of k.
    """
    codes = _BASE_OF[np.frombuffer(text, np.uint8)]
    if len(codes) < k:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes == 4)])
    whole, size, value = codes.astype(np.uint64) & np.uint64(3), 1, None
    length, rest = 0, k
    while rest:  # powers of two that make up k
        if rest & 1:
            value = whole if value is None else (value[: len(value) - size] << np.uint64(2 * size)) | whole[length : length + len(value) - size]
            length += size
        rest >>= 1
        if rest:
            whole, size = (whole[:-size] << np.uint64(2 * size)) | whole[size:], 2 * size
    n = len(codes) - k + 1
    return value[:n][bad[k:] == bad[:-k]].view(np.int64)


_BASE_OF = np.full(256, 4, np.uint8)
for _letter, _code in BASES.items():
    _BASE_OF[[ord(_letter), ord(_letter.lower())]] = _code


def kmers(df: DataFrame, key: str, text: str, k: int, out: str = "value") -> DataFrame:
    """(key, out): one row per k-mer of a nucleotide sequence, ``k`` up to 32; its number has two bits a base.

    Lower case counts, U is T, windows with any other letter are left out, as are
    null texts and texts shorter than k. ``key`` is a BIGINT. Only the key and the
    number leave a task, a piece of a text at a time.
    """
    if not 1 <= k <= 32:
        raise ValueError(f"k must be in [1,32], not {k}")
    schema = pa.schema([(key, pa.int64()), (out, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, sequence in zip(batch.column(0).to_pylist(), batch.column(1)):
                letters = sequence.as_buffer().to_pybytes()
                for low in range(0, max(1, len(letters) - k + 1), PIECE):
                    values = np_kmers(letters[low : low + PIECE + k - 1], k)
                    if len(values):
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(owner, pa.int64()), len(values)), pa.array(values)], schema=schema)

    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"{key} bigint, {out} bigint")


def code_point_pairs(df: DataFrame, key: str, text: str, out: str = "value") -> DataFrame:
    """(key, out): one row per pair of neighbouring characters, four times the first code point plus the second."""
    pairs = df.filter(F.length(text) >= 2).select(key, F.split(text, "").alias("__c"))
    codes = pairs.select(key, F.transform("__c", lambda c: F.ascii(c).cast("bigint")).alias("__c"))
    own = F.slice("__c", F.lit(1), F.size("__c") - 1)
    after = F.slice("__c", F.lit(2), F.size("__c") - 1)
    return codes.select(key, F.explode(F.zip_with(own, after, lambda a, b: a * 4 + b)).alias(out))
