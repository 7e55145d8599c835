import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from binloom.functions import bits, hashing, sizing

EDGES = [0, 1, -1, 2**63 - 1, -(2**63), 12345, 1 << 40, -(1 << 22)]


def exact(value, seed, size):
    h = value % 2**64 * seed % 2**64
    h ^= h >> (64 - size.bit_length())
    return h * hashing.GOLDEN % 2**64 * size >> 64


@pytest.mark.parametrize("size", [1, 2, 63, 7903, 2**31 - 1])
def test_positions_equal_big_integers(spark, size):
    df = spark.createDataFrame([(v,) for v in EDGES], "value bigint")
    got = hashing.positions(df, "value", F.lit(size), F.lit(sizing.hash_shift(size)), 5).collect()
    assert len(got) == 5 * len(EDGES)
    for value, fn, pos in got:
        assert pos == exact(value, hashing.SEEDS[fn], size)
        assert pos == hashing.np_positions(np.array([value]), size, 5)[fn][0]


def test_positions_drop_nulls(spark):
    df = spark.createDataFrame([(None,), (3,)], "value bigint")
    assert hashing.positions(df, "value", F.lit(7), F.lit(61), 2).count() == 2


@given(st.integers(0, 2**64 - 1), st.integers(1, 2**31 - 1))
@settings(max_examples=200, deadline=None)
def test_numpy_high_product(value, factor):
    assert int(hashing.np_product_high(np.array([value], np.uint64), factor)[0]) == value * factor >> 64


def test_wy(spark):
    df = spark.createDataFrame([(v,) for v in EDGES], "value bigint")
    for value, got in hashing.wy(df, "value").collect():
        p = value % 2**64 * hashing.GOLDEN
        assert got % 2**64 == (p % 2**64) ^ (p >> 64)


def test_sizes():
    assert sizing.bin_size_in_bits(0.05, 2, 1000) == 7903
    assert sizing.bin_size_in_bits(0.05, 2, 0) == 0
    correction = sizing.fpr_correction(0.01, 5, 256)
    for splits, value in {1: 1.0, 2: 1.192316, 4: 1.412390, 8: 1.664459, 16: 1.953384, 32: 2.284738, 64: 2.664909, 128: 3.101225, 256: 3.602093}.items():
        assert correction[splits] == pytest.approx(value, abs=1e-6)
    assert len(sizing.fpr_correction(0.05, 2, 65)) == 129
    assert sizing.relaxed_fpr_correction(0.05, 0.3, 2) == pytest.approx(0.3189780835)
    assert [sizing.next_multiple_of_64(x) for x in (0, 1, 64, 65)] == [0, 64, 64, 128]
    assert [sizing.subtract_empty_bins(64, f) for f in (0.0, 0.001, 0.1, 0.99)] == [64, 63, 58, 2]
    assert sizing.subtract_empty_bins(2, 0.9) == 2
    assert sizing.theoretical_fpr(7903, 2, 1000) == pytest.approx(0.05, abs=1e-3)


def test_bits(spark):
    row = spark.createDataFrame([([5, -1], [3, 0])], "x array<bigint>, y array<bigint>")
    x, y = F.col("x"), F.col("y")
    got = row.select(
        bits.bit_and(x, y), bits.bit_or(x, y), bits.bit_xor(x, y), bits.bit_and_not(x, y), bits.bit_not(x), bits.bit_not(x, 66),
        bits.flip(x, 63), bits.get(x, 2), bits.get(x, 1), bits.all_set(x), bits.any_set(y), bits.none_set(y), bits.resize(x, 66),
        bits.resize(x, 130), bits.bit_count(x), bits.all_set(F.array(F.lit(-1).cast("bigint"), F.lit(3).cast("bigint")), 66),
    ).first()
    assert list(got) == [[1, 0], [7, -1], [6, -1], [4, -1], [-6, 0], [-6, 0], [5 - 2**63, -1], True, False, False, True, False, [5, 3], [5, -1, 0], 66, True]


def test_counting_vectors(spark):
    row = spark.createDataFrame([([1, 2, 3], [1, 1, 1], [5])], "x array<bigint>, y array<bigint>, w array<bigint>")
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    got = row.select(bits.counting_add(x, y), bits.counting_subtract(x, y), bits.counting_add_bits(x, w), bits.counting_subtract_bits(x, w), bits.shown(x)).first()
    assert list(got) == [[2, 3, 4], [0, 1, 2], [2, 2, 4], [0, 2, 2], "[1,2,3]"]


def test_kmers(spark):
    t = "AC é🙂x"
    df = spark.createDataFrame([(1, t), (2, "A"), (3, None), (4, "")], "id bigint, text string")
    got = sorted(map(tuple, hashing.code_point_pairs(df, "id", "text").collect()))
    assert got == sorted((1, 4 * ord(a) + ord(b)) for a, b in zip(t, t[1:]))


@pytest.mark.parametrize("k", [1, 2, 3, 6, 7, 20, 31, 32])
def test_kmers_of_bases(spark, monkeypatch, k):
    monkeypatch.setattr(hashing, "PIECE", 16)
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGTacgtUN") for _ in range(n)) for n in (0, 1, 5, 40, 200)] + ["A" * 70, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")

    def want(t):
        t = t.upper().replace("U", "T")
        for i in range(len(t) - k + 1):
            if "N" not in t[i : i + k]:
                v = int("".join(str("ACGT".index(c)) for c in t[i : i + k]), 4)
                yield v - 2**64 if v >= 2**63 else v

    got = {}
    for r in hashing.kmers(df, "k", "t", k).collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == {i: w for i, t in enumerate(texts) if t and (w := list(want(t)))}


def test_all_kmers_differ():
    import itertools

    values = [int(hashing.np_kmers("".join(x).encode(), 6)[0]) for x in itertools.product("ACGT", repeat=6)]
    assert sorted(values) == list(range(4**6))
    with pytest.raises(ValueError):
        hashing.kmers(None, "k", "t", 33)


def test_relaxed_formula_matches_logs():
    assert sizing.relaxed_fpr_correction(0.05, 0.05, 2) == pytest.approx(1.0)
    assert math.isfinite(sizing.fpr_correction(0.999, 1, 64)[64])
