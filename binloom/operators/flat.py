"""The bit-interleaved filter: many Bloom filters side by side, as DataFrames.

A filter has ``bin_size`` rows; row ``pos`` holds bit ``pos`` of every bin, 64
bins to a word. Only words that are not zero are rows of the table ``words``
(ibf_id, pos, word_idx, word). Building is one ``bit_or`` aggregation, a lookup
one join and one ``bit_and``. One table can hold the filters of a whole tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.functions import bits, hashing, sizing
from binloom.operators import arrange, skew
from binloom.session import parallelism, written

#: Filter sizes are below this so that reduced hashes are exact in signed arithmetic.
MAX_BIN_SIZE = 2**31 - 1
#: Largest filter, or block of a filter's words, that is sent to the executors at once: 32 MiB.
BROADCAST_BITS = 2**28
#: Blocks that a filter is looked up in by turns; larger ones are joined.
BLOCKS = 16
#: Words or bins in use that are listed on the driver: 8 MiB of numbers.
LISTED = 1 << 20
#: Values of a query that are counted by one set of bit planes, and words of the queries that are counted side by side.
PIECE, ASIDE = 63, 1 << 14
#: Values times bins that one task looks up.
CELLS = 1 << 27
#: Values of a query that one task looks up.
HOT_QUERY = 1 << 20


@dataclass(frozen=True)
class Filter:
    """One filter: its shape and its words, with ``ibf_id`` 0."""

    bins: int
    bin_size: int
    functions: int
    words: DataFrame
    occupancy: DataFrame | None = None  # (bin, occupancy)

    @property
    def technical_bins(self) -> int:
        return sizing.next_multiple_of_64(self.bins)

    @property
    def bin_words(self) -> int:
        return self.technical_bins // 64

    @property
    def bit_size(self) -> int:
        return self.technical_bins * self.bin_size

    @property
    def hash_shift(self) -> int:
        return sizing.hash_shift(self.bin_size)


def check_shape(bins: int, bin_size: int, functions: int) -> None:
    if bins <= 0:
        raise ValueError(f"a filter needs bins, not {bins}")
    if not 1 <= functions <= 5:
        raise ValueError(f"there are one to five hash functions, not {functions}")
    if not 0 < bin_size <= MAX_BIN_SIZE:
        raise ValueError(f"a bin has 1 to {MAX_BIN_SIZE} bits, not {bin_size}")


def words_of(rows: DataFrame, functions: int) -> DataFrame:
    """Words from (ibf_id, bin, value, bin_size, hash_shift)."""
    placed = hashing.positions(rows, "value", F.col("bin_size"), F.col("hash_shift"), functions)
    return (
        placed.select("ibf_id", "bin", "pos")
        .groupBy("ibf_id", "pos", F.floor(F.col("bin") / 64).cast("int").alias("word_idx"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bin") % 64).cast("int"))).alias("word"))
    )


def occupancy_of(rows: DataFrame, functions: int, words: DataFrame | None = None) -> DataFrame:
    """(ibf_id, bin, occupancy): values that set a bit no smaller value had set, nor ``words`` have.

    Values are taken in ascending unsigned order. A value counts when it is the
    first to set at least one of its positions, which is a minimum per position
    and needs no sorted insertion.
    """
    placed = hashing.positions(rows, "value", F.col("bin_size"), F.col("hash_shift"), functions)
    first = (
        placed.select("ibf_id", "bin", hashing.unsigned_order(F.col("value")).alias("v"), "pos")
        .groupBy("ibf_id", "bin", "pos")
        .agg(F.min("v").alias("v"))
    )
    if words is not None:
        first = first.withColumn("word_idx", F.floor(F.col("bin") / 64).cast("int")).join(words, ["ibf_id", "pos", "word_idx"], "left")
        first = first.filter(F.col("word").isNull() | (F.call_function("getbit", "word", (F.col("bin") % 64).cast("int")) == 0))
    # Distinct (bin, v) in two steps, so that one bin with most values is no single task.
    counted = first.groupBy("ibf_id", "bin", "v").agg(F.lit(1).alias("one"))
    return counted.groupBy("ibf_id", "bin").agg(F.count("one").alias("occupancy"))


def build(
    values: DataFrame, bins: int, bin_size: int, functions: int = 2, track_occupancy: bool = False
) -> Filter:
    """A filter of ``values`` (user_bin_id, value); the user bin is the bin.

    Null and repeated values add nothing; ids outside ``[0, bins)`` are left out.
    """
    check_shape(bins, bin_size, functions)
    rows = _rows(values, bins, bin_size)
    occupancy = None
    if track_occupancy:
        got = occupancy_of(rows.distinct(), functions).select("bin", "occupancy")
        every = values.sparkSession.range(bins).select(F.col("id").alias("bin"))
        occupancy = every.join(got, "bin", "left").select("bin", F.coalesce("occupancy", F.lit(0)).alias("occupancy"))
    return Filter(bins, bin_size, functions, words_of(rows, functions), occupancy)


def _rows(values: DataFrame, bins: int, bin_size: int) -> DataFrame:
    return (
        values.filter(F.col("value").isNotNull() & F.col("user_bin_id").between(0, bins - 1))
        .select(F.lit(0).cast("bigint").alias("ibf_id"), F.col("user_bin_id").alias("bin"), "value")
        .withColumns({"bin_size": F.lit(bin_size), "hash_shift": F.lit(sizing.hash_shift(bin_size))})
    )


def exact_counts(values: DataFrame) -> DataFrame:
    """(user_bin_id, cardinality): distinct values of each bin, in two steps so that a large bin is spread."""
    distinct = values.filter(F.col("value").isNotNull()).select("user_bin_id", "value").distinct()
    return distinct.groupBy("user_bin_id").agg(F.count(F.lit(1)).alias("cardinality"))


def max_bin_size(values: DataFrame, fpr: float, functions: int, max_bin_elements: int = 0) -> int:
    """Bits for the fullest bin; its exact count where none is given."""
    if not max_bin_elements:
        max_bin_elements = exact_counts(values).agg(F.max("cardinality")).first()[0] or 0
    return sizing.bin_size_in_bits(fpr, functions, max_bin_elements)


def of_config(values: DataFrame, config: FilterConfig, max_bin_elements: int = 0) -> Filter:
    """A filter of all user bins of ``values``, sized for its fullest bin or for ``max_bin_elements`` values."""
    bins = config.number_of_user_bins or (values.agg(F.max("user_bin_id")).first()[0] or 0) + 1
    size = max_bin_size(values, config.maximum_fpr, config.number_of_hash_functions, max_bin_elements)
    return build(values, bins, size, config.number_of_hash_functions, config.track_occupancy)


def insert(index: Filter, values: DataFrame) -> Filter:
    """The filter with more values: new words OR the old ones.

    Where occupancy is tracked, those of the new values count that set a bit
    which neither the filter nor a smaller new value had set.
    """
    rows = _rows(values, index.bins, index.bin_size)
    more = words_of(rows, index.functions)
    both = index.words.unionByName(more).groupBy("ibf_id", "pos", "word_idx").agg(F.bit_or("word").alias("word"))
    occupancy = index.occupancy
    if occupancy is not None:
        got = occupancy_of(rows.distinct(), index.functions, index.words).select("bin", F.col("occupancy").alias("more"))
        occupancy = occupancy.join(got, "bin", "left").select("bin", (F.col("occupancy") + F.coalesce("more", F.lit(0))).alias("occupancy"))
    return replace(index, words=both, occupancy=occupancy)


def save(index: Filter, path: str) -> None:
    """Write a filter's tables as Parquet under ``path``, with its shape as a row of its own."""
    spark = index.words.sparkSession
    index.words.write.mode("overwrite").parquet(f"{path}/words")
    if index.occupancy is not None:
        index.occupancy.write.mode("overwrite").parquet(f"{path}/occupancy")
    shape = [(index.bins, index.bin_size, index.functions, index.occupancy is not None)]
    spark.createDataFrame(shape, "bins bigint, bin_size bigint, functions int, occupancy boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Filter:
    shape = spark.read.parquet(f"{path}/shape").first()
    occupancy = spark.read.parquet(f"{path}/occupancy") if shape["occupancy"] else None
    return Filter(shape["bins"], shape["bin_size"], shape["functions"], spark.read.parquet(f"{path}/words"), occupancy)


def same(a: Filter, b: Filter) -> bool:
    """Whether two filters have the same shape and bits."""
    if (a.bins, a.bin_size, a.functions) != (b.bins, b.bin_size, b.functions):
        return False
    x, y = (f.words.select("pos", "word_idx", "word") for f in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


# --- lookups ---------------------------------------------------------------------


def contained(probe: DataFrame, words: DataFrame, functions: int) -> DataFrame:
    """(ibf_id, value, word_idx, word): per value the bins that hold all its bits.

    ``probe`` is distinct (ibf_id, value, bin_size, hash_shift). A word that is
    not in the table is zero, so a group counts only with all its functions.
    """
    placed = hashing.positions(probe, "value", F.col("bin_size"), F.col("hash_shift"), functions)
    return (
        placed.select("ibf_id", "value", "fn", "pos")
        .join(words, ["ibf_id", "pos"])
        .groupBy("ibf_id", "value", "word_idx")
        .agg(F.bit_and("word").alias("word"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") == functions) & (F.col("word") != 0))
        .select("ibf_id", "value", "word_idx", "word")
    )


def bins_of(words: DataFrame) -> DataFrame:
    """Words spread into their bins."""
    spread = words.withColumn("__bit", F.explode(bits.set_bits(F.col("word"))))
    return spread.withColumn("bin", F.col("__bit") + F.col("word_idx").cast("bigint") * 64).drop("word", "word_idx", "__bit")


def _probe(index: Filter, queries: DataFrame) -> DataFrame:
    return (
        queries.filter(F.col("value").isNotNull())
        .select(F.lit(0).cast("bigint").alias("ibf_id"), "value")
        .distinct()
        .withColumns({"bin_size": F.lit(index.bin_size), "hash_shift": F.lit(index.hash_shift)})
    )


def contains(index: Filter, values: DataFrame, strategy: str = "auto") -> DataFrame:
    """(value, user_bin_id): the bins that may hold each distinct value; strategies as in :func:`count`."""
    probe = _probe(index, values)
    index, packed = _packed(index, strategy)
    if packed is not None:
        return _contained_in_arrow(index, packed, probe.select("value"))
    hit = bins_of(contained(probe, index.words, index.functions))
    return hit.filter(F.col("bin") < index.bins).select("value", F.col("bin").alias("user_bin_id"))


def _contained_in_arrow(index: Filter, packed: _Packed, probe: DataFrame) -> DataFrame:
    """Pairs of the distinct values of ``probe``, in tasks of up to ``CELLS`` values times bins; nothing but the values is shuffled."""
    spark, size, functions, unit = probe.sparkSession, index.bin_size, index.functions, packed.unit
    probe = written(probe, "probe")
    rows = probe.repartition(max(parallelism(spark), probe.count() * 64 * packed.width // CELLS), "value")
    schema = pa.schema([("value", pa.int64()), ("user_bin_id", pa.int64())])

    def finder(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, ids = shared.value
            step = max(1, ASIDE // matrix.shape[1])
            for batch in batches:
                values = batch.column("value").to_numpy()
                at = hashing.np_positions(values, size, functions)
                for low in range(0, len(values), step):
                    found = matrix.take(at[0, low : low + step], axis=0)
                    for more in at[1:]:
                        found &= matrix.take(more[low : low + step], axis=0)
                    row, bins = np.divmod(np.flatnonzero(_spread_bits(found).view(bool)), 64 * matrix.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(values[low + row]), pa.array(_bins_at(ids, unit, bins))], schema=schema)

        return run

    out = [rows.mapInArrow(finder(block), "value bigint, user_bin_id bigint") for block in _blocks(index, packed)]
    return reduce(DataFrame.unionByName, out).filter(F.col("user_bin_id") < index.bins)


def count(index: Filter, queries: DataFrame, strategy: str = "auto") -> DataFrame:
    """(query_id, user_bin_id, cnt) where cnt > 0: a value given twice counts twice.

    ``join`` looks words up by a join, a row for each value and word;
    ``broadcast`` sends the whole filter to the executors, and is refused above
    ``BROADCAST_BITS``; ``auto`` does so too, by blocks of words if the filter
    is larger, of which there are at most ``BLOCKS``; only words or bins in use
    are in the blocks, so ids may have gaps. Rows without ``query_id`` are left
    out by either.
    """
    kept = hasattr(queries, "_binloom_path")
    queries = queries.filter(F.col("query_id").isNotNull())
    index, packed = _packed(index, strategy)
    if packed is not None:
        return _count_in_arrow(index, packed, queries.select("query_id", "value", F.lit(1).cast("bigint").alias("t")), kept)
    mult = queries.filter(F.col("value").isNotNull()).groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("m"))
    words = contained(_probe(index, queries), index.words, index.functions)
    return (
        bins_of(mult.join(words, "value").select("query_id", "m", "word_idx", "word"))
        .filter(F.col("bin") < index.bins)
        .groupBy("query_id", F.col("bin").alias("user_bin_id"))
        .agg(F.sum("m").alias("cnt"))
    )


@dataclass(frozen=True)
class _Packed:
    """What the columns of a filter's matrix stand for: words of 64 bins as they are (``unit`` 64), or single bins in use, 64 to a column (1)."""

    words: DataFrame
    ids: Sequence[int] | np.ndarray  # ascending word_idx, or bins
    unit: int

    @property
    def width(self) -> int:
        return -(-len(self.ids) * self.unit // 64)


def _packed(index: Filter, strategy: str) -> tuple[Filter, _Packed | None]:
    """The filter, and how it is sent to the executors; None where it is joined.

    A filter that is too large to be sent at once is packed: what counts is the
    words or bins in use, not the largest id.
    """
    if strategy not in ("auto", "join", "broadcast"):
        raise ValueError(f"no such strategy: {strategy}")
    if strategy == "broadcast" and index.bit_size > BROADCAST_BITS:
        raise ValueError(f"{index.bit_size} bits are too many to broadcast; the limit is {BROADCAST_BITS}")
    step = BROADCAST_BITS // (64 * index.bin_size)
    if strategy == "join" or not step:
        return index, None
    if index.bin_words <= step:
        return index, _Packed(index.words, range(index.bin_words), 64)
    index = replace(index, words=written(index.words, "words"))
    used = written(index.words.groupBy("word_idx").agg(F.bit_or("word").alias("word")), "used")
    words, bins = used.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.bit_count("word")), F.lit(0))).first()
    most = BLOCKS * step
    if words > step and bins <= min(LISTED, 64 * most) and (words > most or 2 * bins <= 64 * words):
        ids = _set_bins(used)
        return index, _Packed(written(_moved(index.words, ids), "packed"), ids, 1)
    if words <= min(LISTED, most):
        ids = np.sort(used.select("word_idx").toArrow()["word_idx"].to_numpy()).astype(np.int64)  # at most LISTED rows
        return index, _Packed(index.words, ids if words else range(1), 64)
    return index, _Packed(index.words, range(index.bin_words), 64) if index.bin_words <= most else None


def _set_bins(used: DataFrame) -> np.ndarray:
    """The bins in ``used`` (word_idx, word), ascending; at most ``LISTED``."""
    held = used.orderBy("word_idx").toArrow()
    row, bit = np.divmod(np.flatnonzero(_spread_bits(held["word"].to_numpy()[:, None]).view(bool)), 64)
    return 64 * held["word_idx"].to_numpy()[row].astype(np.int64) + bit


def _moved(words: DataFrame, ids: np.ndarray) -> DataFrame:
    """Words in which the bin ``ids[i]`` is bin ``i``."""
    places = words.sparkSession.createDataFrame(pa.table({"bin": pa.array(ids), "place": pa.array(np.arange(len(ids)))}))
    return (
        bins_of(words.select("pos", "word_idx", "word"))
        .join(F.broadcast(places), "bin")  # at most LISTED rows
        .groupBy("pos", F.floor(F.col("place") / 64).cast("int").alias("word_idx"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))).alias("word"))
    )


def _blocks(index: Filter, packed: _Packed) -> Iterator[Broadcast]:
    """What was sent: the filter's rows as matrices of at most ``BROADCAST_BITS`` each, with the ids of their columns."""
    step, unit = BROADCAST_BITS // (64 * index.bin_size), packed.unit
    for first in range(0, packed.width, step):
        ids = np.asarray(packed.ids[first * 64 // unit : (first + step) * 64 // unit], np.int64)
        columns = ids if unit == 64 else np.arange(first, min(first + step, packed.width))
        rows = np.zeros((index.bin_size, len(columns)), np.uint64)
        held = packed.words.filter(F.col("word_idx").between(int(columns[0]), int(columns[-1]))).select("pos", "word_idx", "word").toArrow()  # at most BROADCAST_BITS / 64 words
        rows[held["pos"].to_numpy(), np.searchsorted(columns, held["word_idx"].to_numpy())] = held["word"].to_numpy().view(np.uint64)
        yield packed.words.sparkSession.sparkContext.broadcast((rows, ids))


def _bins_at(ids: np.ndarray, unit: int, places: np.ndarray) -> np.ndarray:
    """The user bins of bits of a matrix whose columns have these ids."""
    return ids[places // unit] * unit + places % unit


def _bit_counts(matrix: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(plane, run, word): bit ``plane`` of the number of values of each run that each bin holds; lengths descend.

    ``at`` has the rows of all values by function. The words of a value are added to the planes as 64 counters at once.
    """
    planes = np.zeros((int(lengths[0]).bit_length(), len(starts), matrix.shape[1]), np.uint64)

    def value(j: int, n: int) -> np.ndarray:
        found = matrix.take(at[0, starts[:n] + j], axis=0)
        for rows in at[1:]:
            found &= matrix.take(rows[starts[:n] + j], axis=0)
        return found

    def add(first: int, n: int, carry: np.ndarray, most: int) -> None:
        top = most.bit_length() - 1
        for plane in planes[first:top, :n]:
            more = plane & carry
            plane ^= carry
            carry = more
        planes[top, :n] ^= carry

    def add_two(k: int, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Adds both to plane ``k`` and returns what goes to the next; takes their memory."""
        plane = planes[k, :n]
        low = plane ^ a
        plane &= a
        np.bitwise_xor(low, b, out=a)
        b &= low
        b |= plane
        plane[:] = a
        return b

    longest, j = int(lengths[0]), 0
    while j < longest:
        n = int(np.searchsorted(-lengths, -j))
        if n and lengths[n - 1] >= j + 4:  # four values of each run, which is half the work
            twos = [add_two(0, n, value(k, n), value(k + 1, n)) for k in (j, j + 2)]
            add(2, n, add_two(1, n, *twos), j + 4)
            j += 4
        else:
            add(0, n, value(j, n), j + 1)
            j += 1
    return planes


def _spread_bits(words: np.ndarray) -> np.ndarray:
    """64 columns for each word of the last axis."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")


def _reaching(planes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, bin and count where a run's count is at least its limit, which is above 0."""
    below = np.minimum(limits - 1, (1 << len(planes)) - 1)[:, None]
    above, equal = np.zeros_like(planes[0]), np.full_like(planes[0], -1 % 2**64)
    for k in range(len(planes) - 1, -1, -1):
        wanted = (-(below >> k & 1)).astype(np.uint64)
        above |= equal & planes[k] & ~wanted
        equal &= ~(planes[k] ^ wanted)
    run, word = np.nonzero(above)
    place, bit = np.nonzero(_spread_bits(above[run, word][:, None]))
    counts = np.zeros(len(place), np.int64)
    for k, plane in enumerate(planes):
        counts += _spread_bits(plane[run, word][:, None])[place, bit].astype(np.int64) << k
    return run[place], 64 * word[place] + bit, counts


def _count_in_arrow(index: Filter, packed: _Packed, asked: DataFrame, kept: bool) -> DataFrame:
    """Counts of at least ``t`` from (query_id, value, t), with the filter's rows, or a block of their words, as a matrix in every worker.

    A query's rows stream through one task a block, which holds its counts only;
    those of a query with more than ``HOT_QUERY`` values through several, whose
    counts are added up. What was asked is written once, unless it is ``kept`` as a table, and sorted once for all blocks.
    """
    clean = asked.filter("value IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("bigint").alias("query_id"), "value", F.col("t").cast("bigint").alias("t"))
    clean = skew.salted(clean if kept else written(clean, "asked"), "query_id", ["value"], HOT_QUERY)
    parts = clean.groupBy("query_id").agg(F.max("t").alias("t"), (F.max(skew.SALT) > 0).alias("split")) if _any_hot(clean) else None
    if parts is not None:
        hot = parts.filter("split").select("query_id", F.col("t").alias("limit"))
        clean = clean.join(F.broadcast(hot), "query_id", "left").withColumn("t", F.when(F.col("limit").isNotNull(), F.lit(1)).otherwise(F.col("t"))).drop("limit")
    keys = ["query_id", skew.SALT]
    rows = clean.repartition(*keys).sortWithinPartitions(*keys)
    size, functions, unit = index.bin_size, index.functions, packed.unit
    schema = pa.schema([("query_id", pa.int64()), ("user_bin_id", pa.int64()), ("cnt", pa.int64())])

    def counter(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, bin_ids = shared.value

            def made(ids: np.ndarray, bins: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_bins_at(bin_ids, unit, bins)), pa.array(counts)], schema=schema)

            aside = max(1, ASIDE // matrix.shape[1])
            # A query that may go on in the next batch, or is longer than a piece.
            last, total, limit = None, None, 0

            def ended() -> pa.RecordBatch:
                hit = np.flatnonzero(total >= limit)
                return made(np.full(len(hit), last[0], np.int64), hit, total[hit])

            for batch in batches:
                ids, t, salts = (batch.column(c).to_numpy() for c in ("query_id", "t", skew.SALT))
                at = hashing.np_positions(batch.column("value").to_numpy(), size, functions)
                starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (salts[1:] != salts[:-1])])
                lengths = np.diff(np.r_[starts, len(ids)])
                whole = lengths <= PIECE
                whole[-1] = False
                if (ids[0], salts[0]) == last:
                    whole[0] = False
                for start, length in zip(starts[~whole].tolist(), lengths[~whole].tolist()):
                    if (ids[start], salts[start]) != last:
                        if last is not None:
                            yield ended()
                        last, total, limit = (ids[start], salts[start]), np.zeros(64 * matrix.shape[1], np.int64), max(1, t[start])
                    for low in range(start, start + length, PIECE * aside):
                        pieces = np.arange(low, min(low + PIECE * aside, start + length), PIECE)
                        for k, plane in enumerate(_bit_counts(matrix, at, pieces, np.minimum(start + length - pieces, PIECE))):
                            total += _spread_bits(plane).sum(0, dtype=np.int64) << k
                order = np.flatnonzero(whole)[np.argsort(-lengths[whole], kind="stable")]
                for low in range(0, len(order), aside):
                    some = order[low : low + aside]
                    limits = np.maximum(t[starts[some]], 1)
                    if (limits > lengths[some]).all():
                        continue
                    row, bins, counts = _reaching(_bit_counts(matrix, at, starts[some], lengths[some]), limits)
                    yield made(ids[starts[some]][row], bins, counts)
            if last is not None:
                yield ended()

        return run

    out = [rows.mapInArrow(counter(block), "query_id bigint, user_bin_id bigint, cnt bigint") for block in _blocks(index, packed)]
    counted = reduce(DataFrame.unionByName, out).filter(F.col("user_bin_id") < index.bins)
    if parts is None:
        return counted
    whole = counted.groupBy("query_id", "user_bin_id").agg(F.sum("cnt").alias("cnt"))
    return whole.join(hot, "query_id", "left").filter(F.col("cnt") >= F.coalesce("limit", F.lit(1))).select("query_id", "user_bin_id", "cnt")


def _any_hot(salted: DataFrame) -> bool:
    return not salted.filter(F.col(skew.SALT) > 0).isEmpty()


def count_all(index: Filter, queries: DataFrame) -> DataFrame:
    """As :func:`count`, with a 0 for every other bin of every query."""
    bins_ = queries.sparkSession.range(index.bins).select(F.col("id").alias("user_bin_id"))
    # A full count is queries times bins by definition; the side of bins is the index's width.
    grid = queries.select("query_id").distinct().join(bins_)
    return grid.join(count(index, queries), ["query_id", "user_bin_id"], "left").select(
        "query_id", "user_bin_id", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def membership(index: Filter, queries: DataFrame, threshold: Column | int = 1, strategy: str = "auto") -> DataFrame:
    """(query_id, user_bin_id): bins whose count reaches the threshold; at 0 all bins.

    Of thresholds that differ within a query the largest holds. Rows without
    ``query_id`` are left out.
    """
    kept = hasattr(queries, "_binloom_path")
    queries = queries.filter(F.col("query_id").isNotNull())
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if isinstance(threshold, int) and threshold > 0:
        limits = None
        limited = queries.select("query_id", "value", t.cast("bigint").alias("t"))
    else:
        limits = queries.select("query_id", t.cast("bigint").alias("t")).groupBy("query_id").agg(F.max("t").alias("t"))
        limited = queries.select("query_id", "value").join(limits, "query_id")
    index, packed = _packed(index, strategy)
    if packed is not None:
        hits = _count_in_arrow(index, packed, limited, kept and limits is None).select("query_id", "user_bin_id")
    else:
        most = limited.groupBy("query_id").agg(F.max("t").alias("t"))
        hits = count(index, queries, "join").join(most, "query_id").filter(F.col("cnt") >= F.col("t")).select("query_id", "user_bin_id")
    if limits is None:
        return hits
    bins_ = queries.sparkSession.range(index.bins).select(F.col("id").alias("user_bin_id"))
    return hits.unionByName(limits.filter("t <= 0").select("query_id").join(bins_)).distinct()


# --- maintenance -----------------------------------------------------------------


def clear(index: Filter, *bins: int) -> Filter:
    """The filter with these bins empty; their occupancy is 0 again."""
    for b in bins:
        if not 0 <= b < index.bins:
            raise ValueError(f"bin {b} is not in [0,{index.bins})")
    masks: dict[int, int] = {}
    for b in bins:
        masks[b // 64] = masks.get(b // 64, 0) | 1 << b % 64
    keep = F.lit(-1).cast("bigint")
    for word_idx, mask in masks.items():
        keep = F.when(F.col("word_idx") == word_idx, F.lit(hashing.signed(~mask & (2**64 - 1))).cast("bigint")).otherwise(keep)
    words = index.words.withColumn("word", F.col("word").bitwiseAND(keep)).filter("word <> 0")
    occupancy = index.occupancy
    if occupancy is not None:
        occupancy = occupancy.withColumn("occupancy", F.when(F.col("bin").isin(list(bins)), F.lit(0)).otherwise(F.col("occupancy")))
    return replace(index, words=words, occupancy=occupancy)


def try_grow(index: Filter, bins: int) -> Filter | None:
    """With more bins if no word has to be added, else None."""
    if bins < index.bins or sizing.next_multiple_of_64(bins) != index.technical_bins:
        return None
    return grow(index, bins)


def grow(index: Filter, bins: int) -> Filter:
    """With more bins, empty ones; hashes do not depend on their number, so no word changes."""
    if bins < index.bins:
        raise ValueError("the number of bins must not be smaller than it is")
    occupancy = index.occupancy
    if occupancy is not None:
        more = occupancy.sparkSession.range(index.bins, bins).select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("occupancy"))
        occupancy = occupancy.unionByName(more)
    return replace(index, bins=bins, occupancy=occupancy)


def fill_rate(words: DataFrame) -> DataFrame:
    """(ibf_id, bin, bits): bits set in each bin."""
    return bins_of(words.select("ibf_id", "word_idx", "word")).groupBy("ibf_id", "bin").agg(F.count(F.lit(1)).alias("bits"))


def fullest(sketch_estimates: DataFrame) -> DataFrame:
    """(user_bin_id, estimate) of the bin estimated largest; ties to the smaller id."""
    return sketch_estimates.orderBy(F.desc("estimate"), "user_bin_id").limit(1)


def split_chunks(values: DataFrame, parts: int) -> DataFrame:
    """(user_bin_id, part, value): the distinct values of a bin in ``parts`` runs of like length, in unsigned order."""
    once = values.filter(F.col("value").isNotNull()).select("user_bin_id", "value").distinct()
    placed = arrange.ranked(once, ["user_bin_id"], [hashing.unsigned_order(F.col("value"))])
    sizes = placed.groupBy("user_bin_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(parts)).alias("__size"))
    part = F.floor(F.col("rank") / F.col("__size")).cast("bigint")
    return placed.join(sizes, "user_bin_id").select("user_bin_id", part.alias("part"), "value")
