"""Sizes of filters and the corrections of their false positive rates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def next_multiple_of_64(value: int) -> int:
    return (value + 63) // 64 * 64


def divide_and_ceil(a: int, b: int) -> int:
    return (a + b - 1) // b


def subtract_empty_bins(tmax: int, fraction: float) -> int:
    """Technical bins left when a part of them has to stay empty: at least two, at most all but one."""
    if fraction == 0.0 or tmax <= 2:
        return tmax
    return tmax - min(max(int(tmax * fraction), 1), tmax - 2)


def bin_size_in_bits(fpr: float, hash_count: int, elements: int) -> int:
    """Bits of a Bloom filter that holds ``elements`` values at rate ``fpr``."""
    if elements == 0:
        return 0
    return math.ceil(-(elements * hash_count) / math.log(1 - math.exp(math.log(fpr) / hash_count)))


def fpr_correction(fpr: float, hash_count: int, tmax: int) -> np.ndarray:
    """By how much a bin must grow when a user bin is split into ``s`` bins; index ``s``, 0 unused."""
    splits = np.arange(next_multiple_of_64(tmax) + 1, dtype=float)
    out = np.zeros(len(splits))
    whole = math.log1p(-math.exp(math.log(fpr) / hash_count))
    single = -np.expm1(math.log1p(-fpr) / splits[1:])  # rate of one of s bins
    out[1:] = whole / np.log1p(-np.exp(np.log(single) / hash_count))
    out[1:2] = 1.0
    return out


def relaxed_fpr_correction(fpr: float, relaxed_fpr: float, hash_count: int) -> float:
    """By how much a merged bin may shrink, its rate being ``relaxed_fpr``."""
    load = lambda p: math.log1p(-math.exp(math.log(p) / hash_count))
    return load(fpr) / load(relaxed_fpr)


def theoretical_fpr(bin_size: int, hash_count: int, elements: int) -> float:
    if elements == 0:
        return 0.0
    return math.exp(hash_count * math.log(-math.expm1(-hash_count * elements / bin_size)))


def hash_shift(bin_size: int) -> int:
    return 64 - bin_size.bit_length()


# The same as column expressions.


def next_multiple_of_64_of(value: Column) -> Column:
    return (F.ceil(value / 64) * 64).cast("bigint")


def divide_and_ceil_of(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("bigint")


def subtract_empty_bins_of(tmax: Column, fraction: float) -> Column:
    empty = F.least(F.greatest((tmax * F.lit(fraction)).cast("bigint"), F.lit(1)), tmax - 2)
    return (tmax if fraction == 0.0 else F.when(tmax <= 2, tmax).otherwise(tmax - empty)).cast("bigint")


def bin_size_in_bits_of(elements: Column, fpr: Column | float, hash_count: int) -> Column:
    rate = fpr if isinstance(fpr, Column) else F.lit(fpr)
    return F.ceil(-(elements * hash_count) / F.ln(1 - F.exp(F.ln(rate) / hash_count))).cast("bigint")


def fpr_correction_of(splits: Column, fpr: float, hash_count: int) -> Column:
    whole = math.log1p(-math.exp(math.log(fpr) / hash_count))
    single = -F.expm1(F.lit(math.log1p(-fpr)) / splits)
    return F.when(splits == 1, F.lit(1.0)).otherwise(F.lit(whole) / F.log1p(-F.exp(F.ln(single) / hash_count)))
