"""The filter tree: build, query, save and load.

All filters of a tree share one ``words`` table, keyed by ``ibf_id``. A merged
bin holds the union of the user bins below it, which is what exploding each user
bin along its path gives, so all filters are built in one job and not bottom up.
Queries go down level by level; only merged bins whose count reaches a query's
threshold are followed.

Split user bins are spread over their technical bins in runs of equal length, by
ranks that no task has to sort a whole user bin for.

Planning is quadratic in the user bins of a filter, so more than ``PART`` of them
are dealt to parts of like size, each part is planned by a task of its own, and
the parts' trees hang under filters of ``FAN`` merged bins. The plan, the shapes of
the filters and the map of technical bins are tables; nothing about single user
bins comes to the driver.
"""

from __future__ import annotations

import json
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.config import FilterConfig
from binloom.functions import hashing, sizing
from binloom.operators import arrange, flat, layout as planning, sketch
from binloom.session import having, parallelism, written
from binloom.sources import layout_text

#: User bins that one task plans.
PART = 512
#: Parts, or filters of parts, under one filter.
FAN = 64
#: User bins in a list of those that hold a value, and pairs of query and user bin that one task counts.
LIST, PAIRS = 1 << 16, 1 << 20


class Phases:
    """Seconds by phase: total, longest and number of runs."""

    def __init__(self) -> None:
        self.runs: dict[str, list[float]] = {}

    @contextmanager
    def timed(self, phase: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.runs.setdefault(phase, []).append(time.perf_counter() - began)

    def merge(self, other: Phases) -> None:
        for phase, seconds in other.runs.items():
            self.runs.setdefault(phase, []).extend(seconds)

    def in_seconds(self, phase: str) -> float:
        return sum(self.runs.get(phase, []))

    def max_in_seconds(self, phase: str) -> float:
        return max(self.runs.get(phase, [0.0]))

    def avg_in_seconds(self, phase: str) -> float:
        runs = self.runs.get(phase, [])
        return sum(runs) / len(runs) if runs else 0.0


@dataclass
class Tree:
    """``placed`` and ``merged``: the plan; ``meta``: a row per filter; ``words``; ``tb_map``: what each technical bin is; ``user_bins``: all ids."""

    config: FilterConfig
    placed: DataFrame
    merged: DataFrame
    meta: DataFrame
    words: DataFrame
    tb_map: DataFrame
    user_bins: DataFrame
    depth: int
    occupancy: DataFrame | None = None
    phases: Phases = field(default_factory=Phases)

    @property
    def layout(self) -> planning.Layout:
        """The plan as one object on the driver; for trees that are small enough for that."""
        return layout_text.layout_of(self.placed, self.merged)

    def save(self, path: str) -> None:
        """Write the tables as Parquet under ``path``, with the configuration as JSON."""
        for name in (*_TABLES, "occupancy"):
            frame = getattr(self, name)
            if frame is not None:
                frame.write.mode("overwrite").parquet(f"{path}/{name}")
        head = {"config": asdict(self.config), "depth": self.depth, "occupancy": self.occupancy is not None}
        spark = self.meta.sparkSession
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tree:
        head = json.loads("".join(r[0] for r in spark.read.text(f"{path}/head").collect()))  # one line
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        tables = {name: read(name) for name in _TABLES}
        return cls(FilterConfig(**head["config"]), **tables, depth=head["depth"], occupancy=read("occupancy") if head["occupancy"] else None)


_TABLES = ("placed", "merged", "meta", "words", "tb_map", "user_bins")
_PLAN = "kind string, path array<bigint>, first bigint, n bigint, user_bin_id bigint"


def _prefix(part: int, parts: int) -> tuple[int, ...]:
    """The technical bins that lead to a part's own filter."""
    digits, reach = [], 1
    while reach < parts:
        digits.append(part // reach % FAN)
        reach *= FAN
    return tuple(reversed(digits))


def plan(values: DataFrame, config: FilterConfig, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan for the user bins of ``values``: (path, storage_tb, n_tbs, user_bin_id) and (path, max_bin) of every filter.

    Counts are estimated by sketch, or given as ``sizes`` (user_bin_id,
    cardinality). ``config`` with a ``tmax`` of 0 leaves it to the size of a part.
    """
    unions = not config.disable_estimate_union
    rows = written(sketch.registers(values, config.sketch_bits), "registers") if unions or sizes is None else None
    if sizes is None:
        sizes = sketch.counts(rows, config.sketch_bits).withColumnRenamed("kmer_counts", "cardinality")
    sizes = written(sizes.select("user_bin_id", F.col("cardinality").cast("bigint").alias("cardinality")), "sizes")
    parts = -(-sizes.count() // PART)
    if parts == 1:
        users = sizes.withColumn("part", F.lit(0))
    else:
        users = arrange.sorted_bins(sizes).withColumn("part", F.col("position") % parts).drop("position")
    if unions:
        users = users.join(sketch.store(rows, config.sketch_bits), "user_bin_id")
    else:
        users = users.withColumn("sketch", F.lit(None).cast("binary"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("user_bin_id", ignore_index=True)
        prefix = _prefix(int(frame["part"][0]), parts)
        ids = frame["user_bin_id"].tolist()
        lines = np.stack([np.frombuffer(x, np.uint8, offset=1) for x in frame["sketch"]]) if unions else None
        counts = frame["cardinality"].to_numpy(np.int64)
        if unions:
            counts = np.array([int(sketch.np_estimate(x)) for x in lines], np.int64)
        own = replace(config, number_of_user_bins=len(ids)).validated()
        made = planning.compute_layout(own, counts, lines, validate=False)
        out = [("merged", prefix, made.top_max_bin, None, None)]
        out += [("merged", prefix + p, m, None, None) for p, m in made.merged]
        out += [("placed", prefix + p, tb, n, ids[ub]) for p, tb, n, ub in made.placed]
        # What the part adds to the merged bins above it.
        out += [("above", prefix[:i], prefix[i], int(counts.sum()), None) for i in range(len(prefix))]
        frame = pd.DataFrame(out, columns=["kind", "path", "first", "n", "user_bin_id"])
        return frame.astype({"first": "Int64", "n": "Int64", "user_bin_id": "Int64"}).assign(path=frame["path"].map(list))

    # As many tasks as parts: a part is few bytes, but much work.
    made = written(users.repartition(parts, "part").groupBy("part").applyInPandas(one, _PLAN), "plan")
    placed = made.filter("kind = 'placed'").select("path", F.col("first").alias("storage_tb"), F.col("n").alias("n_tbs"), "user_bin_id")
    above = (
        made.filter("kind = 'above'")
        .groupBy("path", "first")
        .agg(F.sum("n").alias("n"))
        .groupBy("path")
        .agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("max_bin"))
    )
    merged = made.filter("kind = 'merged'").select("path", F.col("first").alias("max_bin")).unionByName(above)
    return placed, merged


def _key(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ";")


def build(values: DataFrame, config: FilterConfig | None = None, layout: planning.Layout | None = None, sizes: DataFrame | None = None) -> Tree:
    """A tree of ``values`` (user_bin_id, value).

    Null ids and values are left out, repeated rows count once. A configured
    user bin without values is an error, as is an empty table.
    """
    spark, phases = values.sparkSession, Phases()
    with phases.timed("read"):
        values = written(
            values.filter(F.col("value").isNotNull() & F.col("user_bin_id").isNotNull()).select("user_bin_id", "value").distinct(), "values"
        )
        users = written(values.select("user_bin_id").distinct(), "users")
        n_users = users.count()
    if not n_users:
        raise ValueError("there are no user bins with values")
    given = config or FilterConfig()
    if given.number_of_user_bins and given.number_of_user_bins != n_users:
        raise ValueError(f"{given.number_of_user_bins} user bins were configured, {n_users} have values; empty user bins are not allowed")
    given = replace(given, number_of_user_bins=n_users)
    config = given.validated()
    functions = config.number_of_hash_functions
    with phases.timed("layout"):
        if layout is None:
            placed, merged = plan(values, given if n_users > PART else config, sizes)
        else:
            placed, merged = layout_text.layout_frames(spark, layout)
            known = placed.select("user_bin_id").distinct()
            if not users.exceptAll(known).isEmpty() or not known.exceptAll(users).isEmpty():
                raise ValueError("the layout and the data have different user bins")
    with phases.timed("allocate"):
        # Filters are numbered by level and path.
        named = merged.select("path", "max_bin", F.size("path").alias("level"), _key(F.col("path")).alias("key"))
        nodes = written(arrange.ranked(named, [], [F.col("level"), F.col("path")], "ibf_id"), "nodes")
        ids = nodes.select("key", "ibf_id")
        children = (
            nodes.filter("level > 0")
            .select(
                _key(F.slice("path", F.lit(1), F.col("level") - 1)).alias("key"),
                F.element_at("path", -1).alias("bin"),
                F.col("ibf_id").alias("next_ibf_id"),
            )
            .join(ids, "key")
            .select("ibf_id", "bin", "next_ibf_id")
        )
        children = written(children, "children")
        # What each user bin is at each filter on its path: (user_bin, ibf, first bin, bins).
        steps = placed.filter(F.size("path") > 0).select(
            "user_bin_id", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("i")
        )
        steps = steps.select(
            "user_bin_id",
            _key(F.slice("path", F.lit(1), F.col("i") - 1)).alias("key"),
            F.element_at("path", F.col("i")).alias("first"),
            F.lit(1).cast("bigint").alias("n"),
            F.lit(False).alias("own"),
        )
        ends = placed.select("user_bin_id", _key(F.col("path")).alias("key"), F.col("storage_tb").alias("first"), F.col("n_tbs").alias("n"), F.lit(True).alias("own"))
        route = written(steps.unionByName(ends).join(ids, "key").drop("key"), "route")
    single = values.join(route.filter("n = 1"), "user_bin_id").select("ibf_id", F.col("first").alias("bin"), "value")
    # A split user bin's values in runs of equal length, in the order of their hashes.
    split = arrange.ranked(
        values.join(route.filter("n > 1"), "user_bin_id").select("user_bin_id", "ibf_id", "first", "n", "value"), ["user_bin_id"], [F.xxhash64("value")]
    )
    runs = split.groupBy("user_bin_id").agg(F.ceil(F.count(F.lit(1)) / F.max("n")).alias("run"))
    split = split.join(runs, "user_bin_id").select("ibf_id", (F.col("first") + F.floor(F.col("rank") / F.col("run"))).cast("bigint").alias("bin"), "value")
    rows = single.unionByName(split)
    with phases.timed("count"):
        # Technical bins of the user bin in a filter's fullest bin; 1 for a merged one.
        widths = (
            nodes.join(route.filter("own").select("ibf_id", F.col("first").alias("max_bin"), "n"), ["ibf_id", "max_bin"], "left")
            .select("ibf_id", "max_bin", F.coalesce("n", F.lit(1)).alias("width"))
        )
        wanted = widths.select("ibf_id", F.explode(F.sequence("max_bin", F.col("max_bin") + F.col("width") - 1)).alias("bin"))
        held = rows.join(wanted, ["ibf_id", "bin"]).distinct().groupBy("ibf_id").agg(F.count(F.lit(1)).alias("held"))
        favourite = children.withColumnRenamed("bin", "max_bin").join(nodes, ["ibf_id", "max_bin"]).select("ibf_id", F.lit(True).alias("favourite"))
        last = route.groupBy("ibf_id").agg(F.max(F.col("first") + F.col("n")).alias("bins"))
        parents = children.select(F.col("next_ibf_id").alias("ibf_id"), F.col("ibf_id").alias("parent_ibf_id"), F.col("bin").alias("parent_bin"))
        shaped = (
            nodes.join(widths.select("ibf_id", "width"), "ibf_id")
            .join(held, "ibf_id", "left")
            .join(favourite, "ibf_id", "left")
            .join(last, "ibf_id")
            .join(parents, "ibf_id", "left")
        )
        fpr = F.when(F.col("favourite"), F.lit(config.relaxed_fpr)).otherwise(F.lit(config.maximum_fpr))
        size = sizing.bin_size_in_bits_of(sizing.divide_and_ceil_of(F.coalesce("held", F.lit(0)), F.col("width")), fpr, functions)
        size = F.when(F.col("width") > 1, F.ceil(size * sizing.fpr_correction_of(F.col("width"), config.maximum_fpr, functions))).otherwise(size).cast("bigint")
        shaped = shaped.withColumn("bin_size", size)
        meta = written(
            shaped.select(
                "ibf_id",
                "path",
                "level",
                "parent_ibf_id",
                "parent_bin",
                "bins",
                sizing.next_multiple_of_64_of(F.col("bins")).alias("technical_bins"),
                "bin_size",
                (F.lit(64) - F.length(F.bin("bin_size"))).alias("hash_shift"),
                F.lit(functions).alias("hash_funs"),
            ),
            "meta",
        )
        least, most, depth = meta.agg(F.min("bin_size"), F.max("bin_size"), F.max("level") + 1).first()
        flat.check_shape(1, least, functions)
        flat.check_shape(1, most, functions)
    own = route.filter("own").select("ibf_id", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("bin"), "user_bin_id")
    tb_map = written(
        meta.select("ibf_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
        .join(children, ["ibf_id", "bin"], "left")
        .join(own, ["ibf_id", "bin"], "left")
        .select(
            "ibf_id",
            "bin",
            F.when(F.col("next_ibf_id").isNotNull(), F.lit("merged")).when(F.col("user_bin_id").isNotNull(), F.lit("user")).otherwise(F.lit("empty")).alias("kind"),
            "user_bin_id",
            "next_ibf_id",
        ),
        "tb_map",
    )
    filled = rows.join(meta.select("ibf_id", "bin_size", "hash_shift"), "ibf_id")
    with phases.timed("fill"):
        words = written(flat.words_of(filled, functions), "words")
    occupancy = flat.occupancy_of(filled.distinct(), functions) if config.track_occupancy else None
    return Tree(config, placed, merged, meta, words, tb_map, users, depth, occupancy, phases)


def count(index: Tree, queries: DataFrame, threshold: str | int = 1) -> DataFrame:
    """(query_id, user_bin_id, cnt) of the user bins whose count reaches the threshold.

    ``queries`` is (query_id, value) with a column of thresholds if ``threshold``
    names one. A value given twice counts twice. Thresholds must be above 0.
    """
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    if isinstance(threshold, int) and threshold <= 0:
        raise ValueError("the threshold must be greater than 0")
    given = queries.filter(F.col("value").isNotNull())
    mult = written(given.groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("m")), "queries")
    limits = written(given.groupBy("query_id").agg(F.max(t).alias("t")).filter("t > 0"), "limits")
    frontier = limits.select("query_id", "t", F.lit(0).cast("bigint").alias("ibf_id"))
    shapes = index.meta.select("ibf_id", "bin_size", "hash_shift")
    out = None
    for level in range(index.depth):
        asked = mult.join(frontier, "query_id")
        probe = asked.select("ibf_id", "value").distinct().join(shapes, "ibf_id")
        hits = flat.contained(probe, index.words, index.config.number_of_hash_functions)
        by_bin = (
            flat.bins_of(asked.join(hits, ["ibf_id", "value"]).select("query_id", "t", "ibf_id", "m", "word_idx", "word"))
            .groupBy("query_id", "t", "ibf_id", "bin")
            .agg(F.sum("m").alias("cnt"))
            .join(index.tb_map, ["ibf_id", "bin"])
        )
        by_bin = written(by_bin, "level") if level + 1 < index.depth else by_bin
        found = (
            by_bin.filter("kind = 'user'")
            .groupBy("query_id", "t", "user_bin_id")
            .agg(F.sum("cnt").alias("cnt"))
            .filter("cnt >= t")
            .select("query_id", "user_bin_id", "cnt")
        )
        out = found if out is None else out.unionByName(found)
        frontier = by_bin.filter("kind = 'merged' AND cnt >= t").select("query_id", "t", F.col("next_ibf_id").alias("ibf_id"))
    return out


def count_all(index: Tree, queries: DataFrame, threshold: str | int = 1) -> DataFrame:
    """As :func:`count`, with a 0 for every other user bin of every query."""
    grid = queries.select("query_id").distinct().join(index.user_bins)
    return grid.join(count(index, queries, threshold), ["query_id", "user_bin_id"], "left").select(
        "query_id", "user_bin_id", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def membership(index: Tree, queries: DataFrame, threshold: str | int = 1) -> DataFrame:
    """(query_id, user_bin_id): user bins that hold at least the threshold's number of a query's values; at 0 all."""
    if isinstance(threshold, int) and threshold <= 0:
        return queries.select("query_id").distinct().join(index.user_bins)
    hits = count(index, queries, threshold).select("query_id", "user_bin_id")
    if isinstance(threshold, int):
        return hits
    free = queries.groupBy("query_id").agg(F.max(threshold).alias("t")).filter("t <= 0").select("query_id")
    return hits.unionByName(free.join(index.user_bins))


def verified(counted: DataFrame, values: DataFrame, queries: DataFrame, threshold: str | int = 1) -> DataFrame:
    """(query_id, user_bin_id, cnt): candidates recounted exactly, those below the threshold dropped.

    Filters have no false negatives, so this is the exact answer.
    """
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    given = queries.filter(F.col("value").isNotNull())
    mult = given.groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("m"))
    limits = given.groupBy("query_id").agg(F.max(t).alias("t"))
    held = values.filter(F.col("value").isNotNull()).select("user_bin_id", "value").distinct()
    held = held.join(mult.select("value").distinct(), "value", "left_semi")
    return (
        counted.select("query_id", "user_bin_id")
        .join(mult, "query_id")
        .join(held, ["user_bin_id", "value"])
        .groupBy("query_id", "user_bin_id")
        .agg(F.sum("m").alias("cnt"))
        .join(limits, "query_id")
        .filter("cnt >= t")
        .select("query_id", "user_bin_id", "cnt")
    )


def held_by(index: Tree, pairs: DataFrame) -> DataFrame:
    """The (value, user_bin_id) of distinct ``pairs`` that the filters hold, all the way from a user bin's own filter to the top."""
    functions = index.config.number_of_hash_functions
    shapes = index.meta.select("ibf_id", "bin_size", "hash_shift")
    above = index.meta.filter("parent_ibf_id IS NOT NULL").select("ibf_id", "parent_ibf_id", "parent_bin")
    own = index.tb_map.filter("kind = 'user'").select("user_bin_id", "ibf_id", "bin")
    at = pairs.join(own, "user_bin_id")
    out = None
    for _ in range(index.depth):
        words = index.words.withColumnRenamed("word_idx", "w")
        placed = hashing.positions(at.join(shapes, "ibf_id"), "value", F.col("bin_size"), F.col("hash_shift"), functions)
        placed = placed.select("ibf_id", "bin", "user_bin_id", "value", "pos", F.floor(F.col("bin") / 64).cast("int").alias("w"))
        hits = (
            placed.join(words, ["ibf_id", "pos", "w"])
            .filter(F.call_function("getbit", "word", (F.col("bin") % 64).cast("int")) == 1)
            .groupBy("ibf_id", "user_bin_id", "value", "bin")
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == functions)
            .drop("n")
        )
        # A value is in one of a split user bin's technical bins; false positives in others go the same way up.
        hits = written(hits.groupBy("ibf_id", "user_bin_id", "value").agg(F.min("bin").alias("bin")), "held")
        top = hits.join(above, "ibf_id", "left")
        done = top.filter("parent_ibf_id IS NULL").select("value", "user_bin_id")
        out = done if out is None else out.unionByName(done)
        at = top.filter("parent_ibf_id IS NOT NULL").select("value", "user_bin_id", F.col("parent_ibf_id").alias("ibf_id"), F.col("parent_bin").alias("bin"))
    return out


def count_verified(index: Tree, values: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, user_bin_id, cnt) of all pairs that share a value: what :func:`count` and :func:`verified` give at a threshold of 1.

    One false positive among a query's values makes a candidate, so candidates
    are a share of all queries times all user bins. The rows of ``values`` that
    are asked for are therefore verified first, and these few pairs are looked up in
    the filters. Bins then come to the queries as lists, and a query's are
    counted where they arrive, so pairs of query and bin are never shuffled.
    """
    given = queries.filter(F.col("value").isNotNull() & F.col("query_id").isNotNull())
    mult = written(given.groupBy("query_id", "value").agg(F.count(F.lit(1)).alias("m")), "queries")
    held = values.filter(F.col("value").isNotNull() & F.col("user_bin_id").isNotNull()).select("user_bin_id", "value")
    held = having(held, mult.select("value")).distinct()
    bins = written(held_by(index, written(held, "pairs")), "bins")
    # Lists of LIST bins on average at most, however many bins a value has.
    lists = max(1, index.user_bins.count() // LIST)
    share = F.pmod(F.xxhash64("user_bin_id"), F.lit(lists))
    listed = bins.groupBy("value", share.alias("part")).agg(F.collect_list("user_bin_id").alias("bins"))
    asked = written(mult.join(listed, "value").select("query_id", "m", "bins"), "asked")
    pairs = asked.agg(F.sum(F.size("bins"))).first()[0] or 0
    spread = asked.repartition(max(parallelism(asked.sparkSession), pairs // PAIRS), "query_id")
    return spread.select("query_id", "m", F.explode("bins").alias("user_bin_id")).groupBy("query_id", "user_bin_id").agg(F.sum("m").alias("cnt"))


def ratio_thresholds(queries: DataFrame, ratio: float = 0.7) -> DataFrame:
    """``queries`` with a ``threshold`` of ``ratio`` times the number of a query's values, cut to a whole number."""
    n = queries.filter(F.col("value").isNotNull()).groupBy("query_id").agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).cast("bigint").alias("threshold"))
    return queries.drop("threshold").join(n, "query_id")
