import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.llm import clusters, distinct, overlaps, packing, runs

BINS = "user_bin_id bigint, value bigint, batch_id bigint, sample_group string, seen_at timestamp_ntz"


def frame(spark, sets):
    """Rows with repeats, nulls and columns whose names the operators use themselves."""
    rows = [(b, v) for b, vs in sets.items() for v in vs] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "user_bin_id bigint, value bigint")
    return df.withColumns({c: F.lit("x") for c in ("bin", "code", "n", "rep", "hub", "r", "rank")})


def similarity(a, b):
    return len(a & b) / len(a | b)


# --- runs ---


@pytest.mark.parametrize("sizes", [(0, 5), (1, 1), (50, 60), (3, 5000), (400, 20000), (5000, 5000)])
def test_shared_equals_sets(sizes):
    rng = np.random.default_rng(sum(sizes))
    a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for n in sizes)
    if len(a) and len(b):
        b = np.unique(np.concatenate([b, a[:: 2 + len(a) // 50]]))
    assert runs.shared(a, b) == runs.shared(b, a) == len(set(a.tolist()) & set(b.tolist()))


def test_codes_survive_encoding():
    for values in ([0], [-(2**63), 2**63 - 1], list(range(-5, 300)), [1, 2**40, 2**62]):
        codes = np.array(values, np.int64)
        assert runs.decode(runs.encode(codes)).tolist() == values


def test_hash_is_a_bijection_of_values(spark):
    assert spark.range(200_000).select(F.xxhash64("id")).distinct().count() == 200_000


def test_large_sets_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(runs, "RUN", 64)
    monkeypatch.setattr(runs, "PARTNERS", 3)
    rng = random.Random(1)
    sets = {1: set(range(5000)), **{b: set(rng.sample(range(6000), 20 * b)) for b in range(2, 12)}}
    codes = runs.distinct_codes(frame(spark, sets)).persist()
    sizes = runs.classes(codes).select("bin", "n").persist()
    cut = runs.sorted_runs(codes, sizes).persist()
    assert cut.filter("bin = 1").count() == 128
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.permutations(sets, 2)], "bin bigint, hub bigint")
    got = runs.shared_counts(pairs, cut, sizes).collect()
    assert len(got) == 110
    for r in got:
        assert r["shared"] == len(sets[r["bin"]] & sets[r["hub"]])
        assert (r["n_bin"], r["n_hub"]) == (len(sets[r["bin"]]), len(sets[r["hub"]]))


# --- clusters ---


def check(spark, sets, nodes=None):
    leaves = nodes or spark.createDataFrame([(b,) for b in [*sets, *sets, None]], "user_bin_id bigint").withColumn("bin", F.lit(1))
    got = clusters.clusters(frame(spark, sets), leaves)
    rows = got.collect()
    assert sorted(r[0] for r in rows) == sorted(sets)
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], []).append(r["user_bin_id"])
    for members in by.values():
        for a, b in itertools.combinations(members, 2):
            assert similarity(sets[a], sets[b]) >= 0.4
    return got, by


def test_families_copies_and_singles(spark):
    rng = random.Random(2)
    sets, number = {}, 10
    families = []
    for size in (2, 3, 12, 30):
        base = rng.sample(range(10**9), 60)
        members = []
        for _ in range(size):
            number += 1
            sets[number] = set(rng.sample(base, 52)) | set(rng.sample(range(10**9, 2 * 10**9), 4))
            members.append(number)
        families.append(members)
    copied = {1: sets[11] | set(), 2: sets[11] | set()}
    sets |= copied
    families[0] += [1, 2]
    sets[5], sets[6] = {77}, set(range(40))
    got, by = check(spark, sets)
    assert sorted(map(sorted, by.values())) == sorted([*map(sorted, families), [5], [6]])
    pairs = {tuple(r) for r in clusters.pairs(got).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= 0.4}
    told = {r["size"]: r for r in clusters.described(got).collect()}
    assert told[30]["typical_bins"][0] == told[30]["cluster"] and len(told[30]["typical_bins"]) == 3


def test_chains_are_split(spark):
    # Neighbours are similar, those further apart are not.
    sets = {b: set(range(40 * b, 40 * b + 100)) for b in range(12)}
    _, by = check(spark, sets)
    assert max(map(len, by.values())) >= 2
    # Two families with a bin between them that is like both.
    left, right = set(range(100)), set(range(1000, 1100))
    sets = {b: left - {b} for b in range(4)} | {b + 10: right - {1000 + b} for b in range(4)}
    sets[50] = set(range(65)) | set(range(1000, 1065))
    _, by = check(spark, sets)
    assert sorted(len(m) for m in by.values())[-2:] in ([4, 4], [4, 5])


def test_random_graphs(spark):
    rng = random.Random(3)
    sets = {b: set(rng.sample(range(24), rng.randint(8, 16))) for b in range(8)}
    check(spark, sets)


def common_core(families):
    """Pairs of similarity 0.407; all sets share a core, which makes 0.357 across pairs."""
    rng = random.Random(5)
    core, sets = rng.sample(range(10**6), 200), {}
    for k in range(families):
        both = [10**7 + 20 * k + i for i in range(20)]
        for b in (2 * k, 2 * k + 1):
            sets[b] = {*core, *both, *range(10**9 + 160 * b, 10**9 + 160 * (b + 1))}
    return sets


def test_pairs_with_a_common_core(spark):
    _, by = check(spark, common_core(50))
    assert sorted(map(sorted, by.values())) == [[b, b + 1] for b in range(0, 100, 2)]


def test_recall_against_a_like_background(spark):
    """Pairs of similarity 0.43 among sets of 0.39: at least 99 in 100 of 200 end in one cluster."""
    rng = random.Random(11)
    core, sets = rng.sample(range(10**6), 561), {}
    for k in range(200):
        both = [10**7 + 41 * k + i for i in range(41)]
        for b in (2 * k, 2 * k + 1):
            sets[b] = {*core, *both, *range(10**9 + 398 * b, 10**9 + 398 * (b + 1))}
    assert 0.425 < similarity(sets[0], sets[1]) < 0.435 and 0.385 < similarity(sets[0], sets[2]) < 0.395
    _, by = check(spark, sets)
    assert sum(m == [m[0], m[0] + 1] and m[0] % 2 == 0 for m in map(sorted, by.values()) if len(m) == 2) >= 198


def test_loose_stars_are_decided_exactly(spark, monkeypatch):
    monkeypatch.setattr(clusters, "FIRST", 3)
    monkeypatch.setattr(clusters, "SPREAD", 4)
    rng = random.Random(12)
    whole = list(range(200))
    sets = {0: set(whole)} | {b: set(rng.sample(whole, rng.randint(90, 150))) for b in range(1, 40)}
    codes = runs.distinct_codes(frame(spark, sets)).persist()
    sizes = runs.classes(codes).select("bin", "n").persist()
    picked = runs.sorted_runs(codes, sizes).persist()
    far = sorted((1 - similarity(sets[0], sets[b]), b) for b in range(1, 40))
    star = spark.createDataFrame([(b, 0, f) for f, b in far], "bin bigint, medoid bigint, far double")
    kept = []
    for _, b in far:
        if all(similarity(sets[b], sets[c]) >= 0.5 for c in kept):
            kept.append(b)
    star = star.filter("far <= 0.5")
    kept = [b for b in kept if 1 - similarity(sets[0], sets[b]) <= 0.5]
    assert sorted(r["bin"] for r in clusters.fitting(star, picked, sizes, 0.5).collect()) == sorted(kept)


def test_long_chains_are_split_around_many_medoids(spark):
    sets = {b: set(range(40 * b, 40 * b + 100)) for b in range(60)}  # each is like the next
    edges = spark.createDataFrame([(b, b + 1) for b in range(59)], "bin bigint, hub bigint")
    scored = spark.createDataFrame([(b, 2) for b in sets], "bin bigint, degree bigint").selectExpr("bin", "degree", "struct(-degree as links, bin * 7919 % 61 as place, bin) as rank")
    chosen = {r["medoid"] for r in clusters.best_nearby(edges, scored).collect()}
    assert len(chosen) > 3 and all(abs(a - b) > clusters.HOPS for a, b in itertools.combinations(chosen, 2))


def test_the_driver_plans_few_joins(spark, monkeypatch):
    """Small tables are broadcast from the driver's heap, in every join of every table that is written."""
    joins, write = [], clusters.written

    def counted(df, *args):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, *args)

    monkeypatch.setattr(clusters, "written", counted)
    rng = random.Random(4)
    base = range(90)
    check(spark, {b: set(rng.sample(base, 60)) for b in range(20)})  # more than FIRST, with doubtful pairs
    assert max(joins) <= 4


def test_counts_of_sets_of_nothing_in_common(spark, monkeypatch):
    """Zeros come out too, also where the hub has no run in a range."""
    monkeypatch.setattr(runs, "RUN", 4)
    sets = {1: set(range(40)), 2: set(range(100, 103)), 3: {5, 200}, 4: set(range(300, 420))}
    codes = runs.distinct_codes(frame(spark, sets)).persist()
    sizes = runs.classes(codes).select("bin", "n").persist()
    pairs = spark.createDataFrame([*itertools.permutations(sets, 2)], "bin bigint, hub bigint")
    got = runs.shared_counts(pairs, runs.sorted_runs(codes, sizes), sizes).collect()
    expected = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.permutations(sets, 2)]
    assert sorted(map(tuple, got)) == expected


def test_members(spark):
    rows = [(5, 7, 1.0, 1), (7, 7, 1.0, 1), (9, 9, 1.0, 0)]
    grouped = spark.createDataFrame(rows, "user_bin_id bigint, cluster bigint, similarity double, degree bigint")
    assert sorted(map(tuple, clusters.members(grouped).collect())) == [(5, 5, 2), (7, 5, 2), (9, 9, 1)]


def test_only_conflicts_with_kept_bins_count(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (2, 4), (7, 8), (7, 9), (8, 9)]
    got = clusters.dropped(spark.createDataFrame(pairs, "closer bigint, bin bigint"))
    assert sorted(r[0] for r in got.collect()) == [2, 4, 8, 9]
    assert clusters.dropped(spark.createDataFrame([], "closer bigint, bin bigint")).count() == 0


def test_clusters_of_nothing(spark):
    bins = frame(spark, {1: {1}})
    none = spark.createDataFrame([], "user_bin_id bigint")
    assert clusters.clusters(bins, none).count() == 0
    assert clusters.pairs(clusters.clusters(bins.limit(0), none)).count() == 0
    alone = clusters.clusters(bins, spark.createDataFrame([(9,)], "user_bin_id bigint"))
    assert [tuple(r) for r in alone.collect()] == [(9, 9, 1.0, 0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, b) for b in range(101, 140)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(edges, "bin bigint, hub bigint")
    got = dict(map(tuple, clusters.components(df).collect()))
    assert got == {i: 0 for i in range(61)} | {b: 100 for b in range(100, 140)} | {200: 200, 201: 200}


# --- overlaps ---


def brute(sets, least, share):
    big = {b: s for b, s in sets.items() if len(s) >= least}
    return {
        (a, b, len(big[a] & big[b])) for a, b in itertools.combinations(sorted(big), 2) if len(big[a] & big[b]) >= share * min(len(big[a]), len(big[b])) - 1e-9
    }


@pytest.mark.parametrize("spread", [2, 1024])
def test_overlaps_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(overlaps, "SPREAD", spread)
    rng = random.Random(spread)
    common = list(range(10_000, 10_150))
    sets = {b: set(rng.sample(range(3000), rng.randint(20, 900))) | set(rng.sample(common, 15)) for b in range(1, 26)}
    sets |= {b: set(rng.sample(common, 110)) for b in (31, 32, 33)}  # nothing but values that all have
    sets |= {41: set(sets[3]), 42: set(sets[3]), 43: set(range(100)), 44: set(range(80, 400))}
    listed, strong = overlaps.overlaps(frame(spark, sets), 100, 0.2)
    got = overlaps.strong_pairs(listed, strong).collect()
    assert {(r[0], r[1], r[2]) for r in got} == brute(sets, 100, 0.2)
    assert len(got) == len({(r[0], r[1]) for r in got})


def test_a_value_that_all_sets_have_is_not_looked_up(spark):
    own = spark.range(5000 * 100).selectExpr("id % 5000 as user_bin_id", "id + 10 as value")
    twice = spark.range(100).selectExpr("6000 as user_bin_id", "id * 5000 + 10 as value")  # one set again
    hot = spark.range(5000).selectExpr("id as user_bin_id", "1 as value")
    listed, strong = overlaps.overlaps(own.union(hot).union(twice), 100, 0.2)
    assert [tuple(r) for r in strong.collect()] == [(6000, 0, 100, 100, 101)]
    codes = runs.distinct_codes(own.union(hot)).join(listed.selectExpr("user_bin_id as bin", "n"), "bin")
    index = codes.join(codes.groupBy("code").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "code")
    assert overlaps.candidates(index, 0.2).count() == 0


def test_sampled_sets_are_found(spark):
    """Sets of 3,000 values, of which a fifth are probes, that share just enough: none of 300 pairs is missed."""
    n = 3000
    left = spark.range(300 * n).selectExpr(f"id div {n} as user_bin_id", "id as value")
    right = spark.range(300 * n).selectExpr(f"id div {n} + 1000 as user_bin_id", f"id + IF(id % {n} < {n // 5}, 0, 100000000) as value")
    _, strong = overlaps.overlaps(left.union(right))
    assert sorted((r["bin"], r["hub"], r["shared"]) for r in strong.collect()) == [(b, b + 1000, n // 5) for b in range(300)]


def test_no_overlaps(spark):
    bins = frame(spark, {1: range(10), 2: range(10)})
    for df in (bins, bins.limit(0)):
        assert overlaps.strong_pairs(*overlaps.overlaps(df)).count() == 0


# --- distinct counts ---


def test_estimates_keep_their_bound(spark):
    sizes = [1, 50, 3000, 20_000, 400_000]
    parts = None
    for i, n in enumerate(sizes):
        df = spark.range(n).selectExpr(f"{i % 2} as batch_id", f"'{i}' as sample_group", f"id * 7919 + {i} * 1000000007L as value")
        df = df.withColumn("seen_at", F.lit("2026-01-01 10:00:00").cast("timestamp_ntz"))
        parts = df if parts is None else parts.union(df)
    parts = parts.union(parts.limit(1000))
    got = {int(r["sample_group"]): r for r in distinct.estimates(distinct.united(distinct.partials(parts), "sample_group"), "sample_group").collect()}
    for i, n in enumerate(sizes):
        assert abs(got[i]["estimate"] - n) <= max(1, got[i]["rel_error"] * n)
        assert got[i]["rel_error"] < 0.06


def test_partials_unite_to_the_whole(spark):
    df = spark.range(5000).selectExpr("id % 5 as batch_id", "concat(' G', id % 3, ' ') as sample_group", "id as value", "cast(null as timestamp_ntz) as seen_at", "id as slot", "id as word")
    df = df.union(df.limit(0)).withColumn("sample_group", F.when(F.col("value") % 7 == 0, None).otherwise(F.col("sample_group")))
    parts = distinct.partials(df)
    whole = distinct.partials(df.withColumn("batch_id", F.lit(0)))
    key = ["day", "sample_group", "slot", "word"]
    assert sorted(map(str, distinct.united(parts, "day", "sample_group").select(key).collect())) == sorted(map(str, whole.select(key).collect()))
    sets = spark.createDataFrame([(1, "g0"), (1, "G1 "), (1, None), (2, "nowhere")], "set_id bigint, sample_group string")
    got = {(r["scope"], r["sample_group"], r["set_id"]): r["estimate"] for r in distinct.distinct_counts(parts, sets).collect()}
    truth = {}
    for v in range(5000):
        truth.setdefault(None if v % 7 == 0 else f"g{v % 3}", set()).add(v)
    for g, values in truth.items():
        assert abs(got["group", g, None] - len(values)) <= 0.06 * len(values)
        assert got["day_group", g, None] == got["group", g, None]
    assert abs(got["set", None, "1"] - len(truth["g0"] | truth["g1"])) <= 0.06 * 3000
    assert got["day_set", None, "1"] == got["set", None, "1"] and ("set", None, "2") not in got
    assert distinct.distinct_counts(distinct.partials(df.limit(0)), sets).count() == 0


# --- packing ---


def laid_out(spark, lengths, capacity, batches=1):
    things = spark.createDataFrame([(i % batches, i, n) for i, n in enumerate(lengths)], "batch_id bigint, user_bin_id bigint, length bigint")
    caps = spark.createDataFrame([(b, capacity) for b in range(batches)], "batch_id bigint, tb_capacity bigint")
    return packing.packed(things, caps).collect(), things, caps


@pytest.mark.parametrize(("open_", "chunk", "slack"), [(256, 50_000, 1.02), (3, 40, 1.15)])
def test_packing_is_valid_and_tight(spark, monkeypatch, open_, chunk, slack):
    monkeypatch.setattr(packing, "OPEN", open_)
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = random.Random(open_)
    lengths = [rng.choice([0, 1, 30, 70, rng.randint(1, 400), 500, 1000, 1001, 3700]) for _ in range(600)]
    rows, *_ = laid_out(spark, lengths, 1000, 2)
    assert sorted(r["user_bin_id"] for r in rows) == list(range(600))
    for b in (0, 1):
        use = {}
        own = [r for r in rows if r["batch_id"] == b]
        for r in own:
            n = r["n_tbs"]
            assert n == max(1, -(-r["length"] // 1000))
            for k in range(n):
                use.setdefault(r["storage_tb"] + k, []).append(min(1000, r["length"] - 1000 * k))
        assert all(sum(x) <= 1000 for x in use.values())
        assert set(use) == set(range(max(use) + 1))
        long = [r for r in own if r["length"] >= 1000]
        room = sum(1000 * r["n_tbs"] - r["length"] for r in long)  # two long items never share a container
        short = sum(r["length"] for r in own if r["length"] < 1000)
        least = sum(r["n_tbs"] for r in long) + max(0, -(-(short - room) // 1000))
        assert len(use) <= least * slack + 2


@pytest.mark.parametrize("lengths", [[1] * 3000, [k % 97 + 3 for k in range(3000)], [250 + k % 7 for k in range(900)]])
def test_leftovers_are_merged_in_rounds(spark, monkeypatch, lengths):
    """Three rounds or more, in each of which no chunk has many more windows than it may."""
    monkeypatch.setattr(packing, "OPEN", 4)
    monkeypatch.setattr(packing, "CHUNK", 20)
    monkeypatch.setattr(packing, "BLOCK", 8)
    rows, things, caps = laid_out(spark, lengths, 100, 1)
    assert sorted(r["user_bin_id"] for r in rows) == list(range(len(lengths)))
    told = packing.checked(packing.packed(things, caps), caps, 0.25).first()
    assert (told["fits"], told["gapless"], told["split_only_long"]) == (True, True, True)
    assert told["tight"] or min(lengths) > 50  # 50 and more of 100 leave room that nothing fits into


def test_checked_sees_faults(spark):
    caps = spark.createDataFrame([(1, 10)], "batch_id bigint, tb_capacity bigint")
    schema = "batch_id bigint, user_bin_id bigint, length bigint, storage_tb bigint, n_tbs bigint"
    good = [(1, 1, 25, 0, 3), (1, 2, 5, 2, 1), (1, 3, 10, 3, 1)]
    faults = {"fits": (1, 2, 6, 2, 1), "gapless": (1, 2, 5, 5, 1), "split_only_long": (1, 2, 5, 2, 2)}
    for name, row in [(None, good[1]), *faults.items()]:
        told = packing.checked(spark.createDataFrame([good[0], row, good[2]], schema), caps).first()
        if name is None:
            assert all(told[c] for c in ("fits", "gapless", "split_only_long", "tight"))
        else:
            assert not told[name]


def test_packing_is_the_same_in_every_run(spark):
    a = laid_out(spark, [37 * i % 500 for i in range(200)], 700)[0]
    b = laid_out(spark, [37 * i % 500 for i in range(200)], 700)[0]
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_items_and_missing_counts(spark):
    store = spark.createDataFrame([(1, 1, 5), (1, 1, None), (2, 1, None), (3, 1, None), (None, 1, 4), (4, None, 4), (5, 2, 9), (6, 3, 9)], "user_bin_id bigint, batch_id bigint, kmer_counts bigint")
    bins = spark.createDataFrame([(2, 1, v % 7) for v in range(30)] + [(2, 1, None), (2, 9, 50), (None, 1, 3)], "user_bin_id bigint, batch_id bigint, value bigint").withColumn("length", F.lit("x"))
    things = packing.items(store, bins)
    assert {tuple(r) for r in things.collect()} == {(1, 1, 5), (1, 2, 7), (1, 3, 0), (2, 5, 9), (3, 6, 9)}
    caps = spark.createDataFrame([(1, 6), (2, None), (3, 0)], "batch_id bigint, tb_capacity bigint")
    got = {r["user_bin_id"]: (r["storage_tb"], r["n_tbs"]) for r in packing.packed(things, caps).collect()}
    assert got[5] == got[6] == (None, None) and got[2][1] == 2 and got[1][1] == 1
    assert packing.packed(things.limit(0), caps).count() == 0
    assert packing.items(store.limit(0), bins).count() == 0
    row = packing.fill(packing.packed(things, caps), caps).first()
    assert (row["n_items"], row["least_tbs"]) == (3, 2)
