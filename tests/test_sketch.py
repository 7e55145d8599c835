import numpy as np
import pytest

from binloom.operators import sketch


@pytest.fixture(scope="module")
def ranges(spark):
    return spark.range(30_000).selectExpr("id div 10000 as user_bin_id", "id as value")


def test_single_precision_estimates():
    for start, value in ((0, 18405.11680625227), (10_000, 18429.448850770688), (20_000, 18427.74236590719)):
        got = sketch.np_estimate(sketch.np_registers(np.arange(start, start + 10_000), 12))
        assert got == pytest.approx(value, abs=1e-5)
    assert sketch.np_estimate(sketch.np_registers(np.arange(10), 5)) == pytest.approx(11.99, abs=1e-3)


def test_registers_equal_numpy_and_merge_to_the_union(spark, ranges):
    rows = sketch.registers(ranges, 10).collect()
    for b in range(3):
        line = np.zeros(1024, np.uint8)
        for r in rows:
            if r[0] == b:
                line[r[1]] = r[2]
        assert (line == sketch.np_registers(np.arange(b * 10_000, (b + 1) * 10_000), 10)).all()
    whole = {(r[0], r[1]) for r in sketch.merged(sketch.registers(ranges, 10)).collect()}
    line = sketch.np_registers(np.arange(30_000), 10)
    assert whole == {(i, int(v)) for i, v in enumerate(line) if v}


def test_estimates_and_counts(spark, ranges):
    got = dict(map(tuple, sketch.counts(sketch.registers(ranges, 12), 12).collect()))
    assert got == {0: 18405, 1: 18429, 2: 18427}
    few = spark.createDataFrame([(1, v) for v in range(10)] + [(2, None)], "user_bin_id bigint, value bigint")
    got = dict(map(tuple, sketch.estimate(sketch.registers(few, 5), 5).collect()))
    assert got == {1: pytest.approx(11.99, abs=1e-3)}
    with pytest.raises(ValueError):
        sketch.registers(few, 4)


def test_store_and_load(spark, ranges):
    rows = sketch.registers(ranges, 8)
    stored = sketch.store(rows, 8)
    assert {len(bytes(r[1])) for r in stored.collect()} == {257}
    assert sorted(map(tuple, sketch.load(stored).collect())) == sorted(map(tuple, rows.collect()))
    broken = spark.createDataFrame([(1, bytearray(b"\x08abc"))], "user_bin_id bigint, sketch binary")
    with pytest.raises(Exception, match="not a stored sketch"):
        sketch.load(broken).collect()
    assert sketch.load(spark.createDataFrame([(1, None)], "user_bin_id bigint, sketch binary")).count() == 0


def test_stored_sketches_of_the_data(spark):
    """The sketches that come with the data are those of its values."""
    d = "/root/testdata/sf0.001"
    bins = spark.read.parquet(f"{d}/bins.parquet")
    kept = spark.read.parquet(f"{d}/data_store.parquet").filter("sketches is not null").select("batch_id", "user_bin_id", "sketches").distinct()
    ours = {(r[0], r[1]): {} for r in kept.collect()}
    for b, u, register, rank in sketch.registers(bins.filter("value is not null"), 10, "batch_id", "user_bin_id").collect():
        if (b, u) in ours:
            ours[b, u][register] = rank
    for b, u, raw in kept.collect():
        assert {i: v for i, v in enumerate(bytes(raw)[1:]) if v} == ours[b, u]


def test_prefix_unions(spark, ranges):
    order = spark.createDataFrame([(2, 0), (0, 1), (1, 2)], "user_bin_id bigint, position bigint")
    got = dict(map(tuple, sketch.prefix_union_estimates(sketch.registers(ranges, 10), order, 10).collect()))
    line = np.zeros(1024, np.uint8)
    for position, b in enumerate((2, 0, 1)):
        line = np.maximum(line, sketch.np_registers(np.arange(b * 10_000, (b + 1) * 10_000), 10))
        assert got[position] == pytest.approx(sketch.np_estimate(line), abs=1)


def test_minhash(spark, ranges):
    table = sketch.minhash(ranges)
    for b, register, rn, value in table.collect():
        assert value == 625 * b + rn
    assert {tuple(r) for r in sketch.minhash_valid(table).collect()} == {(0, True), (1, True), (2, True)}
    few = spark.range(100).selectExpr("0 as user_bin_id", "id as value")
    assert sketch.minhash_valid(sketch.minhash(few)).first()[1] is False
    with pytest.raises(Exception, match="Not enough values"):
        sketch.minhash_strict(few).collect()
    assert sketch.minhash_strict(ranges).count() == 3 * 640
    signed = spark.createDataFrame([(0, -16), (0, 16)], "user_bin_id bigint, value bigint")
    assert [r[3] for r in sketch.minhash(signed).orderBy("rn").collect()] == [1, (2**64 - 16) >> 4]
