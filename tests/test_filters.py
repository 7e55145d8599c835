import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.operators import flat, inspect, kmers, simulate, tree
from binloom.operators.layout import Layout
from binloom.plans import filters, tools
from binloom.plans import tree as tree_plans
from binloom.sources import layout_text
from binloom.streaming.insert import WordStore

PLAIN = FilterConfig(disable_estimate_union=True, disable_rearrangement=True)


def frame(spark, sets):
    return spark.createDataFrame([(b, v) for b, vs in sets.items() for v in vs], "user_bin_id bigint, value bigint")


def asked(spark, queries):
    return spark.createDataFrame([(q, v) for q, vs in queries.items() for v in vs], "query_id bigint, value bigint")


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# --- flat ---


def test_shapes():
    index = flat.Filter(73, 1019, 3, None)
    assert (index.bit_size, index.technical_bins, index.bin_words, index.hash_shift) == (130_432, 128, 2, 54)
    for bad in ((0, 10, 2), (10, 10, 0), (10, 10, 6), (10, 0, 2), (10, 2**31, 2)):
        with pytest.raises(ValueError):
            flat.check_shape(*bad)
    shape = inspect.inspect_filter(index)
    assert (shape["empty_bins"], shape["user_bins"]) == (55, 73)


def test_every_bin_holds_every_value(spark):
    values = spark.range(64).selectExpr("id as user_bin_id").crossJoin(spark.range(64).selectExpr("id as value"))
    index = flat.build(values, 64, 1024)
    assert flat.contains(index, values).count() == 64 * 64
    for gone in ((17,), (8, 17, 45)):
        left = flat.contains(flat.clear(index, *gone), values).select("user_bin_id").distinct()
        assert {r[0] for r in left.collect()} == set(range(64)) - set(gone)
    with pytest.raises(ValueError):
        flat.clear(index, 64)


def test_hot_queries_are_split(spark, monkeypatch):
    monkeypatch.setattr(flat, "HOT_QUERY", 50)
    index = flat.build(frame(spark, {0: range(1000), 1: range(0, 1000, 3), 5: range(900, 950)}), 6, 20_000)
    q = asked(spark, {1: range(1000), 2: range(5), 3: range(910, 930)})
    split, whole = (sorted(map(tuple, flat.count(index, q, s).collect())) for s in ("broadcast", "join"))
    assert split == whole and (1, 0, 1000) in split
    assert pairs(flat.membership(index, q, 300)) == [(1, 0), (1, 1)]


def test_saved_filters_and_occupancy_of_inserts(spark, tmp_path):
    values = frame(spark, {0: range(20), 4: range(10, 30)})
    index = flat.of_config(values, FilterConfig(track_occupancy=True))
    assert (index.bins, index.bin_size) == (5, flat.max_bin_size(values, 0.05, 2))
    flat.save(index, f"file://{tmp_path}/f")
    again = flat.load(spark, f"file://{tmp_path}/f")
    assert flat.same(index, again) and sorted(map(tuple, again.occupancy.collect())) == sorted(map(tuple, index.occupancy.collect()))
    more = flat.insert(index, values)  # nothing new
    assert flat.same(index, more) and sorted(map(tuple, more.occupancy.collect())) == sorted(map(tuple, index.occupancy.collect()))
    grown = flat.insert(index, frame(spark, {1: range(7), 9: [1]}))
    assert not flat.same(index, grown) and dict(map(tuple, grown.occupancy.collect()))[1] == 7
    assert flat.of_config(values, FilterConfig(), max_bin_elements=1000).bin_size > index.bin_size


def test_counts_and_membership(spark):
    index = flat.build(frame(spark, {0: range(20), 4: range(10, 30), 7: range(25, 35)}), 8, 8192)
    q = asked(spark, {0: range(20), 1: range(1024), 2: [5, 5, 5, None], 3: [2000]})
    counts = {(r[0], r[1]): r[2] for r in flat.count_all(index, q).collect()}
    assert [counts[0, b] for b in range(8)] == [20, 0, 0, 0, 10, 0, 0, 0]
    assert [counts[1, b] for b in range(8)] == [20, 0, 0, 0, 20, 0, 0, 10]
    assert counts[2, 0] == 3 and counts[3, 0] == 0
    assert pairs(flat.membership(index, q, 11)) == [(0, 0), (1, 0), (1, 4)]
    assert flat.membership(index, q, 0).count() == 4 * 8
    limits = q.withColumn("t", F.when(F.col("query_id") == 1, 15).otherwise(0))
    assert [p for p in pairs(flat.membership(index, limits, F.col("t"))) if p[0] == 1] == [(1, 0), (1, 4)]


def test_strategies_agree(spark, monkeypatch):
    sets = {b: range(7 * b, 7 * b + 40) for b in range(130)}
    index = flat.build(frame(spark, sets), 130, 211)
    q = asked(spark, {x: [v % 900 for v in range(13 * x, 13 * x + 60)] + [5, 5, None] for x in range(40)}).withColumn("t", F.col("query_id") % 30)
    assert pairs(flat.count(index, q, "join")) == pairs(flat.count(index, q, "broadcast"))
    for t in (7, 0, F.col("t")):
        assert pairs(flat.membership(index, q, t, "join")) == pairs(flat.membership(index, q, t, "broadcast"))
    monkeypatch.setattr(flat, "BROADCAST_BITS", 1000)
    with pytest.raises(ValueError, match="too many"):
        flat.count(index, q, "broadcast")
    with pytest.raises(ValueError, match="no such"):
        flat.count(index, q, "other")
    assert flat.count(index, q).count() > 0


def blocked(monkeypatch):
    """Filters of 211 rows are larger than what is sent at once; a row for each value and word is never made."""
    monkeypatch.setattr(flat, "BROADCAST_BITS", 64 * 211)
    monkeypatch.setattr(flat, "contained", lambda *_: pytest.fail("joined"))


def test_large_filters_count_by_blocks_of_words(spark, monkeypatch):
    sets = {b: range(7 * b, 7 * b + 40) for b in range(130)}
    index = flat.build(frame(spark, sets), 130, 211)
    # Runs of one value, of more than a piece and across batches.
    queries = {x: [v % 900 for v in range(13 * x, 13 * x + 3 * x)] + [5] for x in range(60)} | {99: [*range(900)] * 15}
    q = asked(spark, queries).withColumn("t", F.col("query_id") % 30)
    right = pairs(flat.count(index, q, "join"))
    blocked(monkeypatch)
    assert pairs(flat.count(index, q)) == right
    monkeypatch.setattr(flat, "HOT_QUERY", 200)
    assert pairs(flat.count(index, q)) == right


def test_large_filters_answer_membership_by_blocks_of_words(spark, monkeypatch):
    index = flat.build(frame(spark, {b: range(7 * b, 7 * b + 40) for b in range(130)}), 130, 211)
    q = asked(spark, {x: [v % 900 for v in range(13 * x, 13 * x + 3 * x + 1)] for x in range(60)}).withColumn("t", F.col("query_id") % 30)
    right = [pairs(flat.membership(index, q, t, "join")) for t in (7, 64, 0, F.col("t"))]
    blocked(monkeypatch)
    assert [pairs(flat.membership(index, q, t)) for t in (7, 64, 0, F.col("t"))] == right


def test_large_filters_find_bins_by_blocks_of_words(spark, monkeypatch):
    values = frame(spark, {b: range(7 * b, 7 * b + 40) for b in range(130)})
    index, q = flat.build(values, 130, 211), spark.createDataFrame([(v,) for v in [*range(-5, 1000), 5, 5, None]], "value bigint")
    right = pairs(flat.contains(index, q, "join"))
    blocked(monkeypatch)
    assert pairs(flat.contains(index, q)) == right and set(pairs(values.select("value", "user_bin_id").distinct())) <= set(right)


@pytest.mark.parametrize("far", [lambda b: 1001 * b, lambda b: b + b // 64 * 10**9])
def test_large_filters_of_ids_with_gaps_are_looked_up_by_blocks(spark, monkeypatch, far):
    # Each bin in a word of its own; full words far apart.
    index = flat.build(frame(spark, {far(b): range(7 * b, 7 * b + 40) for b in range(130)}), 3 * 10**9, 211)
    q = asked(spark, {x: [v % 900 for v in range(13 * x, 13 * x + 3 * x + 1)] for x in range(60)})
    values = q.select("value")
    right = [pairs(flat.count(index, q, "join")), pairs(flat.membership(index, q, 20, "join")), pairs(flat.contains(index, values, "join"))]
    assert all(right)
    blocked(monkeypatch)
    assert [pairs(flat.count(index, q)), pairs(flat.membership(index, q, 20)), pairs(flat.contains(index, values))] == right
    empty = flat.build(frame(spark, {0: [None]}), 3 * 10**9, 211)
    assert flat.count(empty, q).isEmpty() and flat.contains(empty, values).isEmpty()


def test_rows_without_query_id_are_left_out(spark):
    index = flat.build(frame(spark, {0: range(40), 1: range(9, 30)}), 2, 211)
    q = spark.createDataFrame([(1, 5), (1, 10), (None, 5), (None, 11)], "query_id bigint, value bigint")
    for strategy in ("join", "broadcast"):
        assert {r[0] for r in flat.count(index, q, strategy).collect()} == {1}
        for t in (1, 0):
            assert {r[0] for r in flat.membership(index, q, t, strategy).collect()} == {1}


def test_small_filter_has_false_positives(spark):
    index = flat.build(frame(spark, {b: range(10) for b in range(3)}), 8, 8, 1)
    counts = {(r[0], r[1]): r[2] for r in flat.count_all(index, asked(spark, {0: range(10)})).collect()}
    assert [counts[0, b] for b in range(8)] == [10, 10, 10, 0, 0, 0, 0, 0]


def test_occupancy_equals_insertion_in_order(spark):
    from binloom.functions.hashing import np_positions
    import numpy as np

    sets = {b: [b * 97 + i * 31 for i in range(60)] for b in range(3)} | {5: [-5, 3]}
    index = flat.build(frame(spark, sets), 6, 150, track_occupancy=True)
    got = dict(map(tuple, index.occupancy.collect()))
    for b in range(6):
        seen, n = set(), 0
        for v in sorted((x % 2**64 for x in sets.get(b, []))):
            p = set(np_positions(np.array([v], np.uint64), 150, 2)[:, 0].tolist())
            n += not p <= seen
            seen |= p
        assert got[b] == n
    assert dict(map(tuple, flat.clear(index, 1).occupancy.collect()))[1] == 0
    assert dict(map(tuple, flat.grow(index, 9).occupancy.collect()))[8] == 0


def test_growing(spark):
    index = flat.build(frame(spark, {0: range(5)}), 73, 64)
    assert flat.try_grow(index, 73).bins == 73
    assert flat.try_grow(index, 50) is None
    assert flat.try_grow(index, 128).bins == 128
    assert flat.try_grow(index, 129) is None
    with pytest.raises(ValueError):
        flat.grow(index, 10)
    grown = flat.grow(index, 129)
    assert grown.bit_size == 192 * 64
    more = flat.insert(grown, frame(spark, {128: range(5)}))
    assert {r[1] for r in flat.contains(more, asked(spark, {0: range(5)})).collect()} >= {0, 128}


def test_dirty_rows(spark):
    rows = spark.createDataFrame([(None, 1, "x"), (1, None, "x"), (-1, 4, "x"), (9, 4, "x"), (1, 7, "x"), (1, 7, "x")], "user_bin_id bigint, value bigint, word string")
    index = flat.build(rows, 4, 100)
    assert pairs(flat.contains(index, rows.filter("value = 7"))) == [(7, 1)]
    empty = flat.build(rows.limit(0), 4, 100, track_occupancy=True)
    assert empty.words.count() == 0 and empty.occupancy.count() == 4
    assert flat.count(empty, asked(spark, {0: [1]})).count() == 0
    assert flat.max_bin_size(rows.limit(0), 0.05, 2) == 0
    assert flat.max_bin_size(rows, 0.05, 2, 20) != flat.max_bin_size(rows, 0.05, 2)


def test_split_chunks(spark):
    got = pairs(flat.split_chunks(frame(spark, {0: [-1, *range(9)]}), 3))
    assert [p for _, p, v in got if v == -1] == [2]
    assert sorted(p for _, p, _ in got) == [0] * 4 + [1] * 4 + [2] * 2


# --- tree ---


def test_small_trees(spark):
    index = tree.build(frame(spark, {0: range(1, 11), 1: range(1, 6), 2: [3, 9, 11]}), PLAIN)
    q = asked(spark, {0: [3, 9, 12, 14], 1: range(15), 2: [1, 2, 3], 3: [8, 9, 10]})
    assert pairs(tree.membership(index, q.filter("query_id in (0, 2)"), 2)) == [(0, 0), (0, 2), (2, 0), (2, 1)]
    assert pairs(tree.membership(index, q.filter("query_id = 1"), 5)) == [(1, 0), (1, 1)]
    assert tree.membership(index, q, 0).count() == 12
    two = tree.build(frame(spark, {0: range(1, 11), 1: range(1, 6)}), PLAIN)
    five = asked(spark, {0: range(1, 6)})
    assert two.meta.first()["bin_size"] == 48
    assert pairs(tree.count_all(two, five, 1)) == [(0, 0, 5), (0, 1, 5)]
    assert pairs(tree.count_all(two, five, 6)) == [(0, 0, 0), (0, 1, 0)]
    assert pairs(tree.membership(two, five, 6)) == []
    with pytest.raises(ValueError):
        tree.count(index, q, 0)


@pytest.fixture(scope="module")
def deep(spark):
    sets = {b: range(16 * b, 16 * b + 20) for b in range(700)}
    return tree.build(frame(spark, sets), FilterConfig(maximum_fpr=0.001, tmax=64, disable_estimate_union=True)), sets


def test_levels(spark, deep):
    index, sets = deep
    assert index.depth >= 2
    q = asked(spark, {b: range(16 * b + 16, 16 * b + 20) for b in range(0, 699, 100)})
    assert pairs(tree.membership(index, q, 4)) == sorted((b, x) for b in range(0, 699, 100) for x in (b, b + 1))
    q = asked(spark, {b: range(16 * b + 5, 16 * b + 9) for b in range(0, 699, 100)})
    assert pairs(tree.membership(index, q, 4)) == [(b, b) for b in range(0, 699, 100)]
    assert inspect.totals(index).first()["user_bins"] == 700
    assert inspect.inspect_tree(index).filter("ibf_id = 0").first()["children"] > 0


def test_no_false_negatives_and_exact_after_verification(spark, deep):
    index, sets = deep
    values = frame(spark, sets)
    q = asked(spark, {q: range(37 * q, 37 * q + 40) for q in range(30)}).withColumn("t", F.lit(7))
    exact = {(r[0], r[1]): r[2] for r in q.join(values, "value").groupBy("query_id", "user_bin_id").count().filter("count >= 7").collect()}
    counted = tree.count(index, q, "t")
    assert set(exact) <= {(r[0], r[1]) for r in counted.collect()}
    assert {(r[0], r[1]): r[2] for r in tree.verified(counted, values, q, "t").collect()} == exact


def test_save_and_load(spark, deep, tmp_path):
    index, _ = deep
    index.save(f"file://{tmp_path}/t")
    again = tree.Tree.load(spark, f"file://{tmp_path}/t")
    assert inspect.same(index, again)
    assert again.layout == index.layout and again.depth == index.depth
    assert index.phases.in_seconds("fill") >= index.phases.max_in_seconds("fill") > 0 < index.phases.avg_in_seconds("layout")


def test_given_layout(spark):
    values = frame(spark, {0: range(1, 11), 1: range(1, 6)})
    text = "#TOP_LEVEL_IBF fullest_technical_bin_idx:0\n#USER_BIN_IDX\tTECHNICAL_BIN_INDICES\tNUMBER_OF_TECHNICAL_BINS\n1\t0\t34\n0\t34\t30\n"
    index = tree.build(values, PLAIN, layout_text.read_layout(text))
    assert pairs(tree.membership(index, asked(spark, {0: range(1, 6)}), 2)) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError, match="different user bins"):
        tree.build(values, PLAIN, Layout(0, [], [((), 0, 1, 5)]))


def test_unions_occupancy_and_errors(spark):
    sets = {b: range(100 * b, 100 * b + 30 + b) for b in range(12)}
    index = tree.build(frame(spark, sets), FilterConfig(sketch_bits=8, empty_bin_fraction=0.1))
    assert index.occupancy.count() > 0
    assert pairs(tree.membership(index, asked(spark, {0: sets[5]}), 30))[0] == (0, 5)
    with pytest.raises(ValueError, match="no user bins"):
        tree.build(frame(spark, sets).limit(0), PLAIN)
    with pytest.raises(ValueError, match="empty user bins"):
        tree.build(frame(spark, sets), FilterConfig(13, disable_estimate_union=True))


def test_ratio_thresholds(spark):
    q = tree.ratio_thresholds(asked(spark, {0: range(10), 1: [1, 2, None]}), 0.7)
    assert {(r[0], r[1]) for r in q.select("query_id", "threshold").collect()} == {(0, 7), (1, 1)}


# --- tools ---


def test_kmer_search(spark):
    texts = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTTTTTT"), (3, None), (4, "x")], "doc bigint, text string")
    index = kmers.build(texts, "doc", k=3)
    q = kmers.queries_of(spark.createDataFrame([(7, "ACGTAC"), (8, "TTTT")], "doc bigint, text string"), "doc", k=3)
    assert pairs(kmers.search(index, q)) == [(7, "1"), (8, "2")]
    assert {(r[0], r[1]): r[2] for r in kmers.counts(index, q).collect()}[8, 1] == 0


def test_simulations(spark):
    got = {r["variant"]: r["rate"] for r in simulate.fpr_check(spark, k=6, elements=500, splits=4).collect()}
    assert got["single"] < 0.08 and got["split_corrected"] < 0.08 < got["split"]
    row = simulate.hash_collisions(spark, 500, 6).first()
    assert row["min_collisions"] <= row["mean_collisions"] <= row["max_collisions"]
    assert abs(row["mean_collisions"] - row["expected"]) < 0.6 * row["expected"]
    assert math.isnan(simulate.hash_collisions(spark, 100, 1).first()["variance"])


def test_streamed_insert_equals_batch(spark, tmp_path):
    sets = {b: range(50 * b, 50 * b + 80) for b in range(6)}
    values = frame(spark, sets)
    folder = f"file://{tmp_path}/in"
    values.repartition(5).write.parquet(folder)
    store = WordStore(spark, f"file://{tmp_path}/words", 6, 997)
    with pytest.raises(ValueError):
        store.current()
    stream = spark.readStream.schema(values.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    store.start(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    words = {tuple(r) for r in store.current().words.select("pos", "word_idx", "word").collect()}
    assert words == {tuple(r) for r in flat.build(values, 6, 997).words.select("pos", "word_idx", "word").collect()}
    assert len(store.versions()) <= 4
    store.add(values.filter("user_bin_id = 0"), store.versions()[-1] + 1)  # values delivered again change nothing
    assert words == {tuple(r) for r in store.current().words.select("pos", "word_idx", "word").collect()}


def test_only_candidates_are_recounted(spark, monkeypatch):
    given = {}
    real = tree.verified
    monkeypatch.setattr(tree, "verified", lambda found, values, asked, t: given.update(found=found, values=values, asked=asked) or real(found, values, asked, t))
    right = filters.filter_membership_verified(spark, "/root/testdata/sf0.001")
    ids = lambda name, column: {r[0] for r in given[name].select(column).distinct().collect()}
    assert ids("asked", "query_id") == ids("found", "query_id") and ids("values", "user_bin_id") == ids("found", "user_bin_id")
    assert right.count() > 0


def test_shared_values_are_counted_without_candidates(spark, deep, monkeypatch):
    index, sets = deep
    values = frame(spark, sets)
    q = asked(spark, {q: [v % 11_000 for v in range(37 * q, 37 * q + 40)] + [5, 5, None] for q in range(30)})
    right = pairs(q.join(values.distinct(), "value").groupBy("query_id", "user_bin_id").count())
    monkeypatch.setattr(tree, "LIST", 100)
    monkeypatch.setattr(tree, "PAIRS", 50)
    assert pairs(tree.count_verified(index, values, q)) == right
    # Values that a user bin has but the filters do not hold are not found.
    gone = dataclasses.replace(index, words=index.words.filter("ibf_id <> 0"))
    assert tree.count_verified(gone, values, q).isEmpty()
    monkeypatch.setattr(tree, "count", lambda *_: pytest.fail("candidates of all queries"))
    assert tree_plans.tree_count_verified(spark, "/root/testdata/sf0.001").count() > 0


def test_kmers_are_counted_without_candidates(spark, monkeypatch):
    monkeypatch.setattr(tree, "count", lambda *_: pytest.fail("candidates of all queries"))
    d = "/root/testdata/sf0.001"
    values, q = tools._sequences(spark, d)
    assert pairs(tools.kmer_count(spark, d)) == pairs(q.join(values.distinct(), "value").groupBy("query_id", "user_bin_id").count())
