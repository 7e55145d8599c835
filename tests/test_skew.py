import pytest
from pyspark.sql import functions as F

from binloom.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    hot = spark.range(6000).selectExpr("7 as user_bin_id", "id % 2500 as value", "id % 3 as batch_id")
    rest = spark.range(4000).selectExpr("id % 90 + 100 as user_bin_id", "id as value", "1 as batch_id")
    dirty = spark.createDataFrame([(None, 5, 1), (8, None, 1), (8, 1, None), (8, 1, 9)], "user_bin_id bigint, value bigint, batch_id bigint")
    return hot.union(rest).union(dirty).withColumns({"n": F.lit("x"), "rank": F.lit(1)})


@pytest.fixture(scope="module")
def capacities(spark):
    return spark.createDataFrame([(0, 1000), (1, 700), (2, 9999), (1, 700)], "batch_id bigint, tb_capacity bigint")


@pytest.mark.parametrize("hot_rows", [None, 50, 10**9])
def test_profile_equals_plain_aggregation(spark, rows, capacities, hot_rows):
    got = {r[0]: tuple(r)[1:] for r in skew.bin_profile(rows, capacities, hot_rows).collect()}
    plain = rows.groupBy("user_bin_id").agg(F.count(F.lit(1)), F.count_distinct("value"), F.count_distinct("batch_id")).collect()
    assert {k: v[:3] for k, v in got.items()} == {r[0]: tuple(r)[1:] for r in plain}
    # 2000 values in each of three batches: 2 + 3 + 1 technical bins.
    assert got[7][3] == 6 and got[8][3] == 0 and got[None] == (1, 1, 1, 1)


def test_heavy_bins_and_empty_input(spark, rows, capacities):
    assert [r[0] for r in skew.heavy_bins(skew.bin_profile(rows, capacities)).collect()] == [7]
    none = skew.bin_profile(rows.limit(0), capacities)
    assert none.count() == 0 and skew.heavy_bins(none).count() == 0


def test_hot_keys_are_spread(spark, rows):
    sizes = skew.salted(rows, "user_bin_id", ["value"], 500).groupBy("user_bin_id", skew.SALT).count().collect()
    assert max(r[2] for r in sizes) < 1200
    assert len([r for r in sizes if r[0] == 7]) == 12


def test_salted_aggregate(spark, rows):
    got = skew.salted_aggregate(rows, "user_bin_id", ["value"], {"s": F.sum("value"), "m": F.max("value")}, {"s": F.sum("s"), "m": F.max("m")}, 200)
    plain = rows.groupBy("user_bin_id").agg(F.sum("value"), F.max("value"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}


@pytest.mark.parametrize("value", ["7", "cast(null as bigint)"])
def test_a_hot_value_is_combined_before_the_shuffle(spark, capacities, value):
    one = spark.range(0, 90_000, 1, 4).selectExpr("1 as user_bin_id", f"{value} as value", "0 as batch_id")
    rest = spark.range(10_000).selectExpr("1 as user_bin_id", "id + 100 as value", "1 as batch_id")
    once = one.union(rest).groupBy("user_bin_id", "batch_id", "value").agg(F.count(F.lit(1)).alias("n"))
    pieces = skew.salted(once, "user_bin_id", ["value"], 1000).groupBy(skew.SALT).agg(F.count(F.lit(1)).alias("rows")).collect()
    assert len(pieces) == 11 and max(r["rows"] for r in pieces) < 1300
    got = tuple(skew.bin_profile(one.union(rest), capacities, 1000).first())
    assert got == (1, 100_000, 10_000 + (value == "7"), 2, 15 + (value == "7"))


def test_a_machine_folder_is_refused_on_a_cluster(monkeypatch):
    from binloom import session

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session)


def test_scratch_keeps_what_is_kept(spark):
    import os

    from binloom.session import scratch, written

    with scratch(spark) as keep:
        a, b = written(spark.range(3)), keep(written(spark.range(4)))
    assert b.count() == 4 and not os.path.exists(a._binloom_path.removeprefix("file://"))


@pytest.mark.parametrize("most", [0, 100])
def test_rows_having_keys(spark, monkeypatch, most):
    from binloom import session

    monkeypatch.setattr(session, "KEYS", most)
    df = spark.range(50).selectExpr("id % 5 as a", "id as b", "id as c")
    keys = spark.createDataFrame([(1, 6), (1, 6), (2, 3), (None, 1)], "a bigint, b bigint")
    got = session.having(df, keys)
    assert [tuple(r) for r in got.collect()] == [(1, 6, 6)]
    assert not most or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
