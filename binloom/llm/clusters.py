"""Grouping user bins into clusters of mutually similar value sets (problem 1).

MinHash banding proposes links, exact Jaccard similarity on sorted runs
verifies them, connected components forms groups, and groups that are not
mutually similar are split around their medoids.

A group is never compared pair by pair unless it must be. Equal sets are
collapsed first. A bucket of a band compares its members with one of them;
further pairs are compared only where a member is not like that one and the
distances do not tell. In a component all members are compared with the medoid;
as Jaccard distance obeys the triangle inequality, two members whose distances
to the medoid add up to no more than the allowed distance are similar without
being compared. Of the rest the closest few are decided first, and only what is
like all of them that stay is compared among itself, so that pairs are compared
in number only where they are alike and belong into the result.

Members that do not fit are linked anew among themselves. What is left of loose
groups is split around many medoids at once: every bin that ranks best within
``HOPS`` links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm import runs
from binloom.session import forget, having, scratch, written

#: Bands and their rows: sets of similarity 0.4 share none once in 4,700 pairs, of 0.1 one only in 8 of 9.
BANDS = 128
ROWS = 3
#: Orders by which a bucket's hub is chosen, one for each band modulo this.
ORDERS = 4
#: Members of a bucket, or of a star, whose pairs with all others are one task's.
SPREAD = 1024
#: Closest members of a star that are decided before the rest.
FIRST = 16
#: Links within which a medoid of a loose group ranks best.
HOPS = 4

_rng = np.random.Generator(np.random.PCG64(20240501))
_MASKS = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64)
_FACTORS = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)

_MINIMA = [f"h{i}" for i in range(ROWS)]
_BANDS = "bin bigint, n bigint, band int, " + ", ".join(f"{h} bigint" for h in _MINIMA)
_BANDS_ARROW = pa.schema([("bin", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), *((h, pa.int64()) for h in _MINIMA)])


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minima of every band, for each run."""
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            parts = [runs.decode(x) for x in batch.column("run").to_pylist()]
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            codes = np.concatenate(parts).view(np.uint64)
            out = np.empty((ROWS, len(parts), BANDS), np.int64)
            for band in range(BANDS):
                for row in range(ROWS):
                    hashed = (codes ^ _MASKS[band, row]) * _FACTORS[band, row]
                    out[row, :, band] = np.minimum.reduceat(hashed, starts).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("bin").to_numpy(), BANDS)),
                    pa.array(np.repeat(batch.column("n").to_numpy(), BANDS)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(parts))),
                    *(pa.array(x.ravel()) for x in out),
                ],
                schema=_BANDS_ARROW,
            )


def buckets(picked: DataFrame) -> DataFrame:
    """(bin, n, band, bucket): the bucket of each set, of ``n`` values, in every band."""
    columns = ["bin", "n", "bits", "run"]
    single = picked.filter("bits = 0").select(*columns).mapInArrow(_minima, _BANDS)
    flip = F.lit(-(2**63)).cast("bigint")  # unsigned order
    several = (
        picked.filter("bits > 0")
        .select(*columns)
        .mapInArrow(_minima, _BANDS)
        .groupBy("bin", "n", "band")
        .agg(*[F.min(F.col(h).bitwiseXOR(flip)).alias(h) for h in _MINIMA])
        .select("bin", "n", "band", *[F.col(h).bitwiseXOR(flip).alias(h) for h in _MINIMA])
    )
    return written(single.unionByName(several).select("bin", "n", "band", F.xxhash64("band", *_MINIMA).alias("bucket")), "bands")


def links(bands: DataFrame, picked: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(bin, hub): similar pairs that connect all similar pairs that share a bucket.

    Every member of a bucket is compared with the bucket's hub. Two members
    that are both like the hub are connected by it. Of the other pairs those
    are left out that cannot be similar, as their distances to the hub differ
    by more than the allowed distance; all the rest are compared.
    """
    order = F.xxhash64("bin", F.col("band") % F.lit(ORDERS))  # no two bins of a band have the same
    # One shuffle brings a bucket's members together, for its hub and for the join with it.
    met = bands.repartition("bucket")
    hubs = (
        met.groupBy("bucket")
        .agg(F.min_by("bin", order).alias("hub"), F.min_by("n", order).alias("nh"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
    )
    members = written(met.join(hubs, "bucket").filter("bin <> hub").select("bucket", "size", "bin", "n", "hub", "nh"), "members")
    pair = [F.least("bin", "hub").alias("bin"), F.greatest("bin", "hub").alias("hub")]
    alike = F.least("n", "nh") >= F.lit(least) * F.greatest("n", "nh")
    spokes = written(members.filter(alike).select(*pair).distinct(), "near")
    measured = written(
        runs.shared_counts(spokes, picked, reps).select("bin", "hub", _similarity().alias("similarity")), "measured"
    )
    both = measured.unionByName(measured.select(F.col("hub").alias("bin"), F.col("bin").alias("hub"), "similarity"))
    # Sets of too different sizes were not compared: bounds of their distance.
    apart = F.lit(1) - F.col("similarity")
    at = members.join(both, ["bin", "hub"], "left").select(
        "bucket",
        "size",
        "bin",
        "n",
        F.coalesce(apart, F.lit(1) - F.least("n", "nh") / F.greatest("n", "nh")).alias("low"),
        F.coalesce(apart, F.lit(1.0)).alias("high"),
        (F.coalesce("similarity", F.lit(0.0)) < least).alias("failed"),
    )
    # A bucket's pairs are spread over tasks by one of the two members.
    salts = F.ceil(F.col("size") / F.lit(SPREAD)).cast("int")
    x = at.filter("failed").select(
        "bucket",
        F.pmod(F.xxhash64("bin"), salts).cast("int").alias("salt"),
        F.col("bin").alias("hub"),
        F.col("n").alias("nh"),
        F.col("low").alias("low_x"),
        F.col("high").alias("high_x"),
    )
    y = at.select("bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "bin", "n", "low", "high", "failed")
    slack = 1e-9
    more = (
        x.join(y, ["bucket", "salt"])
        .filter(F.when(F.col("failed"), F.col("bin") < F.col("hub")).otherwise(F.lit(True)) & alike)
        .filter(F.greatest(F.col("low") - F.col("high_x"), F.col("low_x") - F.col("high")) <= 1 - least + slack)
        .select(*pair)
        .distinct()
        .join(spokes, ["bin", "hub"], "left_anti")
    )
    more = written(more, "more")
    if not more.isEmpty():
        found = runs.shared_counts(more, picked, reps).select("bin", "hub", _similarity().alias("similarity"))
        measured = measured.unionByName(found)
    return written(measured.filter(F.col("similarity") >= least).select("bin", "hub"), "edges")


def components(edges: DataFrame, a: str = "bin", b: str = "hub") -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its smallest node.

    Alternates the two star operations: every node first hands its larger
    neighbours, then its smaller ones, to the smallest node it knows, until
    only stars around smallest nodes are left. Each step is a written table, so
    the plan stays short and a lost executor costs one step.
    """
    spark = edges.sparkSession
    ends = [F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(2).alias("up"))]
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "stars")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        then = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "stars")
        forget(spark, now)
        now = then
        # In a star every node has one smaller neighbour, or is the smallest itself.
        nodes = now.select(F.inline(F.array(*ends))).groupBy("node").agg(
            F.count_if(F.col("up") == 1).alias("ups"), F.max("up").alias("most")
        )
        if nodes.filter("ups > 1 or ups = 1 and most = 2").isEmpty():
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _similarity() -> F.Column:
    return F.col("shared") / (F.col("n_bin") + F.col("n_hub") - F.col("shared"))


def dropped(conflicts: DataFrame) -> DataFrame:
    """(bin): the bins of ``conflicts`` (closer, bin) that conflict with a closer bin that is kept.

    Bins without an open conflict with a closer one are kept for sure, and
    those in conflict with them dropped, until none is open.
    """
    spark = conflicts.sparkSession
    out, now = None, conflicts
    while not now.isEmpty():
        kept = now.select(F.col("closer").alias("bin")).distinct().join(now.select("bin"), "bin", "left_anti")
        gone = written(now.join(kept.withColumnRenamed("bin", "closer"), "closer", "left_semi").select("bin").distinct(), "gone")
        out = gone if out is None else out.unionByName(gone)
        then = written(now.join(gone, "bin", "left_anti").join(gone.withColumnRenamed("bin", "closer"), "closer", "left_anti"), "open")
        forget(spark, now)
        now = then
    return conflicts.select("bin") if out is None else out


def best_nearby(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """(bin, medoid): bins whose best bin within ``HOPS`` links is itself the best within as many."""
    both = edges.select("bin", "hub").union(edges.select("hub", "bin"))
    both = written(both.union(both.select("bin", "bin")).distinct(), "both")
    best = both.select("bin").distinct().join(scored.select("bin", F.col("rank").alias("best")), "bin")
    for _ in range(HOPS):
        spread = both.join(best.withColumnRenamed("bin", "hub"), "hub")
        best = written(spread.groupBy("bin").agg(F.min("best").alias("best")), "best")
    medoids = best.filter(F.col("best.bin") == F.col("bin")).select(F.col("bin").alias("medoid"))
    return best.select("bin", F.col("best.bin").alias("medoid")).join(medoids, "medoid", "left_semi")


def _conflicts(pairs: DataFrame, picked: DataFrame, reps: DataFrame, least: float) -> DataFrame | None:
    """(closer, bin): those of ``pairs`` (bin, hub), the closer as ``bin``, that are not similar; None if all are."""
    pairs = written(pairs, "doubtful")
    if pairs.isEmpty():
        return None
    unlike = runs.shared_counts(pairs, picked, reps).filter(_similarity() < least)
    found = written(unlike.select(F.col("bin").alias("closer"), F.col("hub").alias("bin")), "conflicts")
    return None if found.isEmpty() else found


def fitting(star: DataFrame, picked: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The rows of ``star`` (bin, medoid, far) that stay: by distance, each that is like all closer ones that stay."""
    allowed = 1 - least

    def pairs(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x = x.filter(F.col("far") > allowed / 2).withColumnsRenamed({"bin": "x", "far": "fx"})
        y = y.withColumnsRenamed({"bin": "y", "far": "fy"})
        doubtful = (F.col("fx") + F.col("fy") > allowed) & (F.struct("fy", "y") < F.struct("fx", "x"))
        return x.join(y, on).filter(doubtful).select(F.col("y").alias("bin"), F.col("x").alias("hub"))

    place = F.row_number().over(Window.partitionBy("medoid").orderBy("far", "bin"))
    first = written(star.withColumn("place", place).filter(F.col("place") <= FIRST).drop("place"), "first")
    found = _conflicts(pairs(first, first, ["medoid"]), picked, reps, least)
    kept = first if found is None else written(first.join(dropped(found), "bin", "left_anti"), "kept")
    rest = written(star.join(first.select("bin"), "bin", "left_anti"), "rest")
    if rest.isEmpty():
        return kept
    found = _conflicts(pairs(rest, kept, ["medoid"]), picked, reps, least)
    if found is not None:
        rest = written(rest.join(found.select("bin").distinct(), "bin", "left_anti"), "rest")
    salts = rest.groupBy("medoid").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPREAD)).cast("int").alias("salts"))
    salted = rest.join(salts, "medoid")
    x = salted.withColumn("salt", F.pmod(F.xxhash64("bin"), F.col("salts").cast("bigint")).cast("int")).drop("salts")
    y = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    found = _conflicts(pairs(x, y, ["medoid", "salt"]), picked, reps, least)
    return kept.unionByName(rest if found is None else rest.join(dropped(found), "bin", "left_anti"))


def clusters(
    bins: DataFrame, nodes: DataFrame, positions: DataFrame | None = None, least: float = 0.4
) -> DataFrame:
    """(user_bin_id, cluster, similarity, degree): each user bin that has a leaf in ``nodes``.

    ``cluster`` is the medoid's id; every two bins of a cluster have a Jaccard
    similarity of at least ``least``; ``similarity`` is that to the medoid.
    The medoid is the bin of highest degree in the graph of verified links;
    ties go to the place in the layout order (``positions``), then to the
    smaller id. A bin like no other is a cluster of its own, as is one without
    values. Nulls in any column, repeated nodes and rows, and nodes without
    sketch change nothing; empty tables give no rows. The result is a written
    table.
    """
    with scratch(bins.sparkSession) as keep:
        return keep(written(_clusters(bins, nodes, positions, least), "clusters"))


def _clusters(bins: DataFrame, nodes: DataFrame, positions: DataFrame | None, least: float) -> DataFrame:
    leaves = nodes.filter(F.col("user_bin_id").isNotNull()).select("user_bin_id").distinct()
    codes = written(runs.distinct_codes(having(bins, leaves)), "codes")
    sets = written(runs.classes(codes), "sets")
    reps = sets.filter("bin = rep").select("bin", "n")
    picked = written(runs.sorted_runs(codes, reps), "runs")

    bands = buckets(picked)
    edges = links(bands, picked, reps, least)
    degrees = (
        edges.select("bin").unionAll(edges.select("hub")).groupBy("bin").agg(F.count(F.lit(1)).alias("degree"))
    )
    if positions is None:
        placed = degrees.withColumn("place", F.lit(None).cast("bigint"))
    else:
        where = positions.groupBy(F.col("user_bin_id").alias("bin")).agg(F.min("positions").alias("place"))
        placed = degrees.join(where, "bin", "left")
    rank = F.struct((-F.col("degree")).alias("links"), F.coalesce("place", F.lit(2**62)).alias("place"), F.col("bin"))
    scored = written(placed.select("bin", "degree", rank.alias("rank")), "scored")

    done = None
    rest = edges
    while not rest.isEmpty():
        if done is None:
            grouped = components(rest).join(scored.withColumnRenamed("bin", "node"), "node")
            medoids = grouped.groupBy("component").agg(F.min_by("node", "rank").alias("medoid"))
            members = grouped.join(medoids, "component").select("medoid", F.col("node").alias("bin"))
        else:
            members = best_nearby(rest, scored)
        members = written(members, "members")
        star = runs.shared_counts(
            members.filter("bin <> medoid").select("bin", F.col("medoid").alias("hub")), picked, reps
        ).select("bin", F.col("hub").alias("medoid"), (F.lit(1) - _similarity()).alias("far"))
        slack = 1e-9
        star = written(star.filter(F.col("far") <= 1 - least + slack), "star")
        kept = fitting(star, picked, reps, least).select("bin", "medoid", (F.lit(1) - F.col("far")).alias("similarity"))
        centres = members.filter("bin = medoid").select("bin", "medoid", F.lit(1.0).alias("similarity"))
        placed = written(kept.unionByName(centres), "placed")
        done = placed if done is None else done.unionByName(placed)
        linked = rest.select("bin").union(rest.select("hub")).distinct()
        left = written(linked.join(placed.select("bin"), "bin", "left_anti"), "left")
        if left.isEmpty():
            break
        rest = links(bands.join(left, "bin", "left_semi"), picked, reps, least)

    if done is None:
        done = reps.select("bin", F.col("bin").alias("medoid"), F.lit(1.0).alias("similarity")).limit(0)
    filled = (
        sets.select(F.col("bin").alias("user_bin_id"), F.col("rep").alias("bin"))
        .join(done, "bin", "left")
        .join(scored.select("bin", "degree"), "bin", "left")
        .select(
            "user_bin_id",
            F.coalesce("medoid", "bin").alias("cluster"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
            F.coalesce("degree", F.lit(0)).alias("degree"),
        )
    )
    bare = leaves.join(sets.select(F.col("bin").alias("user_bin_id")), "user_bin_id", "left_anti").select(
        "user_bin_id", F.col("user_bin_id").alias("cluster"), F.lit(1.0).alias("similarity"), F.lit(0).cast("bigint").alias("degree")
    )
    return filled.unionByName(bare)


def described(grouped: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, typical_bins, mean_similarity) of every cluster.

    The most typical members are those most similar to the medoid, which is
    itself the first, then those with most links, then the smallest ids. Only
    ``typical`` candidates of each cluster leave a task.
    """
    order = F.struct(-F.col("similarity"), -F.col("degree"), F.col("user_bin_id"))
    ranked = grouped.withColumn(
        "o", F.when(F.col("user_bin_id") == F.col("cluster"), F.struct(F.lit(-2.0), F.lit(0).cast("bigint"), "user_bin_id")).otherwise(order)
    )
    sizes = ranked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("similarity"), 6).alias("mean_similarity")
    )
    firsts = ranked.select("cluster", "o").withColumn(
        "rn", F.row_number().over(Window.partitionBy("cluster").orderBy("o"))
    ).filter(F.col("rn") <= typical)
    tops = firsts.groupBy("cluster").agg(F.sort_array(F.collect_list("o")).alias("t"))
    return sizes.join(tops, "cluster").select(
        "cluster", "size", F.transform("t", lambda x: x["user_bin_id"]).alias("typical_bins"), "mean_similarity"
    )


def pairs(grouped: DataFrame) -> DataFrame:
    """(user_bin_a, user_bin_b): the pairs of different bins in one cluster, smaller id first."""
    a = grouped.select("cluster", F.col("user_bin_id").alias("user_bin_a"))
    b = grouped.select("cluster", F.col("user_bin_id").alias("user_bin_b"))
    return a.join(b, "cluster").filter("user_bin_a < user_bin_b").select("user_bin_a", "user_bin_b")


def members(grouped: DataFrame) -> DataFrame:
    """(user_bin_id, first_bin, size): the compact form of :func:`pairs`; a cluster is named by its smallest bin."""
    sizes = grouped.groupBy("cluster").agg(F.min("user_bin_id").alias("first_bin"), F.count(F.lit(1)).alias("size"))
    return grouped.join(sizes, "cluster").select("user_bin_id", "first_bin", "size")
