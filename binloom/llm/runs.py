"""Sorted runs of large sets, and their intersection sizes.

A set is a user bin's distinct values. Each value is replaced by ``code``, its
64-bit XXH64 hash: for inputs of eight bytes that hash is a bijection, so codes
are as good as values for comparing sets, and they are spread evenly over the
64-bit range however the values are. The code range of a set of ``n`` values is
cut into ``2^bits`` equal ranges so that a range holds about ``RUN`` values;
hence no row, group or task holds a whole large set. One run is one range,
sorted and delta-encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values a run holds on average, at most.
RUN = 1 << 15
#: Partners of one hub run that one task compares.
PARTNERS = 2048
#: Exponential search pays when one run has this many times the other's values.
GALLOP = 12


def encode(codes: np.ndarray) -> bytes:
    """Delta-encode ascending int64 codes: count and width, the first code, then the gaps."""
    gaps = np.diff(codes.view(np.uint64))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    cut = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + codes[:1].astype("<i8").tobytes() + cut.tobytes()


def decode(run: bytes) -> np.ndarray:
    width = run[0]
    body = np.frombuffer(run, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[1:, :width] = body
    gaps[0] = np.frombuffer(run, np.uint8, count=8, offset=1)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64).view(np.int64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many codes two ascending runs share.

    Runs of like size are merged linearly. Otherwise the longer one is searched:
    from the place of the last block of the shorter run, steps that double find
    the stretch that can hold the next block, and only that stretch is searched.
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or a[-1] < b[0] or b[-1] < a[0]:
        return 0
    if len(b) < GALLOP * len(a):
        both = np.concatenate([a, b])
        both.sort(kind="stable")  # merges the two ascending runs
        return int(np.count_nonzero(both[1:] == both[:-1]))
    found, low, size, block = 0, 0, len(b), 256
    for start in range(0, len(a), block):
        part = a[start : start + block]
        low = _gallop(b, part[0], low)
        if low >= size:
            break
        high = min(size, _gallop(b, part[-1], low) + 1)
        stretch = b[low:high]
        at = np.searchsorted(stretch, part)
        at[at == len(stretch)] = len(stretch) - 1
        found += int(np.count_nonzero(stretch[at] == part))
    return found


def _gallop(b: np.ndarray, code: np.int64, low: int) -> int:
    """The first place from ``low`` on whose code is not below ``code``."""
    step, size = 1, len(b)
    high = low
    while high < size and b[high] < code:
        low, high = high + 1, high + step
        step *= 2
    high = min(high, size)
    return low + int(np.searchsorted(b[low:high], code))


def stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of an input sorted by ``keys``, whatever batches they come in.

    Holds one group and one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            now = tuple(c[start] for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def distinct_codes(bins: DataFrame) -> DataFrame:
    """(bin, code): the distinct values of each user bin; nulls are no values."""
    return (
        bins.filter(F.col("user_bin_id").isNotNull() & F.col("value").isNotNull())
        .select(F.col("user_bin_id").alias("bin"), F.xxhash64("value").alias("code"))
        .distinct()
    )


def classes(codes: DataFrame) -> DataFrame:
    """(bin, rep, n): each set with the smallest id among the sets equal to it, and its size.

    Equal sets are found by a fingerprint of their size and two exclusive-ors
    of independent hashes, so a group of copies is never compared pair by pair.
    """
    prints = codes.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("code", F.lit(1))).alias("x1"),
        F.bit_xor(F.xxhash64("code", F.lit(2))).alias("x2"),
    )
    reps = prints.groupBy("n", "x1", "x2").agg(F.min("bin").alias("rep"))
    return prints.join(reps, ["n", "x1", "x2"]).select("bin", "rep", "n")


def range_bits(n) -> F.Column:
    """Bits of the code that name the range of a set with ``n`` values."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(RUN))))).cast("int")


def range_of(code, bits) -> F.Column:
    return F.when(bits == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", code, F.lit(64) - bits))


_RUNS = "bin bigint, bits int, r bigint, n bigint, run binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for (owner, r), rows in stretches(batches, ["bin", "r"]):
        codes = rows.column("code").to_numpy()
        out.append((int(owner), int(rows.column("bits")[0].as_py()), int(r), int(rows.column("n")[0].as_py()), encode(codes)))
        if len(out) >= 2000:
            yield _batch(out, _RUNS_ARROW)
            out = []
    if out:
        yield _batch(out, _RUNS_ARROW)


_RUNS_ARROW = pa.schema([("bin", pa.int64()), ("bits", pa.int32()), ("r", pa.int64()), ("n", pa.int64()), ("run", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def sorted_runs(codes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bin, bits, r, n, run) of the sets in ``sizes`` (bin, n)."""
    cut = (
        codes.join(sizes.select("bin", "n"), "bin")
        .withColumn("bits", range_bits(F.col("n")))
        .withColumn("r", range_of(F.col("code"), F.col("bits")))
    )
    return cut.repartition("bin", "r").sortWithinPartitions("bin", "r", "code").mapInArrow(_runs, _RUNS)


_SLICE = "hub bigint, r bigint, salt int, bin bigint, n_bin bigint, n_hub bigint, run binary"
_SLICE_ARROW = pa.schema(
    [("hub", pa.int64()), ("r", pa.int64()), ("salt", pa.int32()), *((c, pa.int64()) for c in ("bin", "n_bin", "n_hub")), ("run", pa.binary())]
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the range of their hub that runs are in, and cut those that are in several."""
    for batch in batches:
        bits, hub_bits = (batch.column(c).to_numpy() for c in ("bits", "hub_bits"))
        if (hub_bits <= bits).all():
            r = pa.array(batch.column("r").to_numpy() >> (bits - hub_bits))
            yield pa.RecordBatch.from_arrays([r if c == "r" else batch.column(c) for c in _SLICE_ARROW.names], schema=_SLICE_ARROW)
            continue
        out = []
        for row in batch.to_pylist():
            same = (row["salt"], row["bin"], row["n_bin"], row["n_hub"])
            if row["hub_bits"] <= row["bits"]:
                out.append((row["hub"], row["r"] >> (row["bits"] - row["hub_bits"]), *same, row["run"]))
                continue
            codes = decode(row["run"])
            r = codes.view(np.uint64) >> np.uint64(64 - row["hub_bits"])
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for start, end in zip(starts, np.r_[starts[1:], len(r)]):
                out.append((row["hub"], int(r[start]), *same, encode(codes[start:end])))
        yield _batch(out, _SLICE_ARROW)


_SHARED = "bin bigint, hub bigint, n_bin bigint, n_hub bigint, shared bigint"
_SHARED_ARROW = pa.schema([(c, pa.int64()) for c in ("bin", "hub", "n_bin", "n_hub", "shared")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each hub run against the runs that follow it; the hub's has a null ``bin``."""
    key, hub = None, None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("hub", "r", "salt", "bin", "n_bin", "n_hub", "run")]
        for owner, r, salt, other, n_bin, n_hub, run in zip(*columns):
            if other is None:
                key, hub = (owner, r, salt), decode(run)
            else:
                out.append((other, owner, n_bin, n_hub, shared(decode(run), hub) if key == (owner, r, salt) else 0))
        if out:
            yield _batch(out, _SHARED_ARROW)


def shared_counts(pairs: DataFrame, runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bin, hub, shared, n_bin, n_hub) for ``pairs`` (bin, hub) of sets with runs; 0 where nothing is shared.

    A hub's run is sent once to each task that needs it, and the runs of its
    partners, cut to the hub's ranges, stream past it, so a pair costs the size
    of its ``bin`` however large the hub is. Hubs with more than ``PARTNERS``
    partners are spread over several tasks. The sizes travel with the runs, and
    each run that streams past gives a row, so nothing is joined to the counts:
    every join is planned, and broadcast while small, by the driver.
    """
    n = sizes.select(F.col("bin").alias("hub"), F.col("n").alias("n_hub"))
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).cast("int").alias("salts"))
    legs = (
        pairs.select("bin", "hub")
        .join(salts.join(n, "hub"), "hub")
        .withColumn("salt", F.pmod(F.xxhash64("bin"), F.col("salts").cast("bigint")).cast("int"))
        .withColumn("hub_bits", range_bits(F.col("n_hub")))
        .join(runs.select("bin", "bits", "r", F.col("n").alias("n_bin"), "run"), "bin")
        .select("hub", "hub_bits", "bits", "r", "salt", "bin", "n_bin", "n_hub", "run")
        .mapInArrow(_cut, _SLICE)
    )
    none = F.lit(None).cast("bigint")
    hubs = (
        salts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .join(runs.select(F.col("bin").alias("hub"), "r", "run"), "hub")
        .select("hub", "r", "salt", none.alias("bin"), none.alias("n_bin"), none.alias("n_hub"), "run")
    )
    return (
        hubs.unionByName(legs)
        .repartition("hub", "r", "salt")
        .sortWithinPartitions("hub", "r", "salt", F.col("bin").asc_nulls_first())
        .mapInArrow(_compare, _SHARED)
        .groupBy("bin", "hub", "n_bin", "n_hub")
        .agg(F.sum("shared").alias("shared"))
        .select("bin", "hub", "shared", "n_bin", "n_hub")
    )
