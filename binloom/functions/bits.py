"""Algebra of bit vectors (``ARRAY<BIGINT>`` of 64-bit words) and counting vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def bit_and_not(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


def bit_not(a: Column, size: int | None = None) -> Column:
    """All bits flipped; those from ``size`` on, if given, stay 0."""
    flipped = F.transform(a, F.bitwise_not)
    if size is None or size % 64 == 0:
        return flipped
    tail = F.lit((1 << size % 64) - 1).cast("bigint")
    return F.transform(flipped, lambda x, i: F.when(i == size // 64, x.bitwiseAND(tail)).otherwise(x))


def flip(a: Column, bit: int) -> Column:
    mask = F.lit((1 << bit % 64) - (1 << 64 if bit % 64 == 63 else 0)).cast("bigint")
    return F.transform(a, lambda x, i: F.when(i == bit // 64, x.bitwiseXOR(mask)).otherwise(x))


def get(a: Column, bit) -> Column:
    word = F.element_at(a, (F.lit(bit) / 64).cast("int") + 1)
    return F.call_function("getbit", word, (F.lit(bit) % 64).cast("int")).cast("boolean")


def all_set(a: Column, size: int | None = None) -> Column:
    """Whether the first ``size`` bits, or all words, are set."""
    if size is None or size % 64 == 0:
        return F.forall(a, lambda x: x == -1)
    tail = F.lit((1 << size % 64) - 1).cast("bigint")
    whole = F.forall(F.slice(a, 1, size // 64), lambda x: x == -1) if size >= 64 else F.lit(True)
    return whole & (F.element_at(a, size // 64 + 1).bitwiseAND(tail) == tail)


def any_set(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def none_set(a: Column) -> Column:
    return ~any_set(a)


def resize(a: Column, size: int) -> Column:
    """Shorter, or longer with zeros."""
    words = (size + 63) // 64
    padded = F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), words))
    cut = F.slice(padded, 1, words)
    if size % 64 == 0:
        return cut
    tail = F.lit((1 << size % 64) - 1).cast("bigint")
    return F.transform(cut, lambda x, i: F.when(i == words - 1, x.bitwiseAND(tail)).otherwise(x))


def assigned(size: int, bit: bool) -> Column:
    """A vector of ``size`` equal bits; without any, the empty one."""
    words, tail = divmod(size, 64)
    whole = F.array_repeat(F.lit(-1 if bit else 0).cast("bigint"), words)
    last = F.lit((1 << tail) - 1 if bit else 0).cast("bigint")
    return F.concat(whole, F.array(last)) if tail else whole


def push_back(a: Column, size: int, bit: bool) -> Column:
    """The vector of ``size`` bits with one more."""
    longer = resize(a, size + 1)
    return flip(longer, size) if bit else longer


def bit_count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def set_bits(word: Column) -> Column:
    """The places 0..63 of the bits set in a word."""
    places = F.sequence(F.lit(0), F.lit(63))
    return F.filter(places, lambda i: F.call_function("getbit", word, i) == 1)


def counting_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def counting_subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _expanded(words: Column) -> Column:
    one = lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", w, i).cast("bigint"))
    return F.flatten(F.transform(words, one))


def counting_add_bits(a: Column, words: Column) -> Column:
    """Add a bit vector, one bit per count; a bit beyond the counts is dropped."""
    return F.zip_with(a, F.slice(_expanded(words), F.lit(1), F.size(a)), lambda x, y: x + F.coalesce(y, F.lit(0)))


def counting_subtract_bits(a: Column, words: Column) -> Column:
    return F.zip_with(a, F.slice(_expanded(words), F.lit(1), F.size(a)), lambda x, y: x - F.coalesce(y, F.lit(0)))


def shown(a: Column) -> Column:
    """``[a,b,c]`` as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
