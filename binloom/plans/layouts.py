"""Ordering, planning and text of layouts."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.config import FilterConfig, read_config, write_config
from binloom.functions import sizing
from binloom.operators import arrange, flat, layout, tree
from binloom.plans.common import supplier_parts
from binloom.sources import layout_text
from binloom.session import table, written


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return flat.exact_counts(table(spark, d, "bins").filter("user_bin_id IS NOT NULL"))


def sort_bins(spark: SparkSession, d: str) -> DataFrame:
    return arrange.sorted_bins(_counts(spark, d))


def size_intervals(spark: SparkSession, d: str) -> DataFrame:
    ordered = written(arrange.sorted_bins(_counts(spark, d)), "order")
    return arrange.intervals(ordered, 0.5)


def _supplier_counts(spark: SparkSession, d: str) -> np.ndarray:
    """Suppliers are few: a count for each fits the driver."""
    rows = sorted((r[0], r[1]) for r in flat.exact_counts(supplier_parts(spark, d)).toLocalIterator())
    return np.array([n for _, n in rows])


def _simple(spark: SparkSession, d: str) -> layout.Layout:
    counts = _supplier_counts(spark, d)
    n = sizing.next_multiple_of_64(len(counts))
    space = layout.Workspace(counts, layout.sort_by_cardinality(counts, list(range(len(counts)))), sizing.fpr_correction(0.05, 2, n), 0.319)
    made = layout.Layout()
    made.top_max_bin = layout.simple_layout(space, n, (), made)
    return made


def _planned(spark: SparkSession, d: str) -> layout.Layout:
    counts = _supplier_counts(spark, d)
    config = FilterConfig(number_of_user_bins=len(counts), tmax=64, disable_estimate_union=True).validated()
    return layout.compute_layout(config, counts)


def _sound(placed: DataFrame, merged: DataFrame) -> DataFrame:
    """(user_bin, times, inside, alone): how often a user bin is placed, and whether in a filter of the layout and in bins of its own."""
    key = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
    spread = layout_text.technical_bins(placed).select(key("path").alias("at"), "bin", "user_bin_id")
    # A merged bin is taken by the filter below it.
    below = merged.filter(F.size("path") > 0).select(
        key(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at"), F.element_at("path", -1).alias("bin"), F.lit(None).cast("bigint").alias("user_bin_id")
    )
    shared = spread.unionByName(below).groupBy("at", "bin").agg(F.count(F.lit(1)).alias("n"))
    known = merged.select(key("path").alias("at"), F.lit(True).alias("known"))
    rows = spread.join(shared, ["at", "bin"]).join(known, "at", "left")
    times = placed.groupBy("user_bin_id").agg(F.count(F.lit(1)).alias("times"))
    return (
        rows.groupBy(F.col("user_bin_id"))
        .agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("inside"), F.bool_and(F.col("n") == 1).alias("alone"))
        .join(times, "user_bin_id")
        .select(F.col("user_bin_id").alias("user_bin"), "times", "inside", "alone")
    )


def layout_simple(spark: SparkSession, d: str) -> DataFrame:
    return _sound(*layout_text.layout_frames(spark, _simple(spark, d)))


def layout_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return _sound(*layout_text.layout_frames(spark, _planned(spark, d)))


def layout_with_unions(spark: SparkSession, d: str) -> DataFrame:
    """Clustering compares all pairs of user bins, so tasks plan parts of them; counts, sketches and plan stay tables."""
    parts = supplier_parts(spark, d)
    placed, merged = tree.plan(parts, FilterConfig(tmax=64, sketch_bits=8))
    suppliers = parts.filter("value IS NOT NULL").select("user_bin_id").distinct()
    numbers = arrange.ranked(suppliers, [], [F.col("user_bin_id")], "number")
    placed = placed.join(numbers, "user_bin_id").select("path", "storage_tb", "n_tbs", F.col("number").alias("user_bin_id"))
    return _sound(placed, merged)


# Inputs of the planner and the layouts it must make of them, as "path;tb;width;user bin", and fullest bins as "path:bin".
_FIXTURES = {
    "equal_but_one": (([500, 1000, 500, 500, 500, 500, 500, 500], 4, 1.2, 0.0), "0;1;7 1;1;6 2;0;22;3 2;22;21;4 2;43;21;5 3;0;42;1 3;42;11;0 3;53;11;2 :3 2:22 3:0"),
    "with_empty_bins": (([500, 1000, 500, 500, 500, 500, 500, 500], 5, 1.2, 0.001), "0;1;7 1;1;6 2;0;21;3 2;21;21;4 2;42;21;5 3;0;43;1 3;43;10;0 3;53;10;2 :3 2:0 3:43"),
    "three_levels": (([50, 1000, 1000, 50, 5, 10, 10, 5], 5, 1.2, 0.0), "0;0;0;45;6 0;0;45;13;5 0;0;58;3;7 0;0;61;3;4 0;1;2;0 0;3;2;3 1;2;2 3;2;1 :1 0:1 0;0:45"),
    "one_each": (([500, 500, 500, 500], 4, 1.2, 0.0), "0;1;3 1;1;2 2;1;1 3;1;0 :0"),
    "split_last": (([60, 600, 1000, 800, 800], 5, 1.0, 0.0), "0;0;63;1 0;63;1;0 1;1;4 2;1;3 3;2;2 :1 0:0"),
    "steep": (([11090, 5080, 3040, 1020, 510, 500], 2, 1.2, 0.0), "0;0;0;33;4 0;0;33;31;5 0;1;0;57;2 0;1;57;7;3 1;0;53;0 1;53;11;1 :1 0:1 1:0 0;0:33 0;1:0"),
    "two_pairs": (([500, 500, 500, 500], 2, 1.0, 0.0), "0;0;32;2 0;32;32;3 1;0;32;0 1;32;32;1 :0 0:0 1:0"),
    "four_pairs": (([500, 500, 500, 500, 500, 500, 500, 500], 2, 1.0, 0.0), "0;0;0;32;5 0;0;32;32;4 0;1;0;32;7 0;1;32;32;6 1;0;0;32;1 1;0;32;32;0 1;1;0;32;3 1;1;32;32;2 :0 0:0 1:0 0;0:0 0;1:0 1;0:0 1;1:0"),
    "simple": (([100, 40, 20, 20], 9, 0.0, 0.0), "0;1;3 1;1;2 2;2;1 4;5;0 :0"),
}


def layout_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """(fixture, entry): what is planned for small inputs whose layouts are known."""
    rows = []
    for name, ((counts, bins, alpha, empty), _) in _FIXTURES.items():
        if name == "simple":
            made = layout.Layout()
            space = layout.Workspace(np.array(counts), list(range(len(counts))), np.ones(65), 1.0)
            made.top_max_bin = layout.simple_layout(space, bins, (), made)
        else:
            config = FilterConfig(len(counts), tmax=bins, alpha=alpha, empty_bin_fraction=empty, disable_estimate_union=True, disable_rearrangement=True)
            made = layout.compute_layout(config, counts, validate=False)
        rows += [(name, ";".join(map(str, (*path, tb, n, ub)))) for path, tb, n, ub in made.placed]
        rows += [(name, f"{';'.join(map(str, path))}:{most}") for path, most in [((), made.top_max_bin), *made.merged]]
    return spark.createDataFrame(rows, "fixture string, entry string")


def layout_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Layouts of both planners in one text, read back by the driver and by the executors; and configurations of three versions."""
    both = [_planned(spark, d), _simple(spark, d)]
    text = "".join(map(layout_text.write_layout, both))
    again = layout_text.read_layouts("@something before\n" + text)
    parsed = layout_text.parse_lines(spark.createDataFrame([(x,) for x in text.splitlines()], "line string"))
    given = layout_text.layout_frames(spark, both[0])[0].unionByName(layout_text.layout_frames(spark, both[1])[0])
    same = parsed.exceptAll(given).isEmpty() and given.exceptAll(parsed).isEmpty()
    rows = [("layouts", len(again), again == both), ("lines", parsed.count(), same)]
    config = FilterConfig(number_of_user_bins=20, tmax=64, track_occupancy=True, empty_bin_fraction=0.25)
    for version, gone in ((3, ()), (2, ("track_occupancy",)), (1, ("track_occupancy", "empty_bin_fraction"))):
        lines = [x for x in write_config(config).replace('"version": 3', f'"version": {version}').splitlines() if not any(g in x for g in gone)]
        text = re.sub(r",\n@( *\})", r"\n@\1", "\n".join(lines))
        read = read_config("noise\n" + text)
        want = replace(config, **({"empty_bin_fraction": 0.0, "track_occupancy": False} if version == 1 else {}))
        rows.append((f"config {version}", read.number_of_user_bins, read == want))
    return spark.createDataFrame(rows, "what string, n bigint, same boolean")


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "layout_ub").filter("storage_tb IS NOT NULL AND n_tbs IS NOT NULL").distinct()
    return layout_text.layout_lines(rows)


def technical_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = layout_text.technical_bins(table(spark, d, "layout_ub"), "batch_id")
    return rows.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ";"))


def layout_graph(spark: SparkSession, d: str) -> DataFrame:
    """Filters of every batch's layout: user bins stored in each, technical bins these need, its fullest bin. A batch is a task."""
    merged = table(spark, d, "layout_mb").select("batch_id", "path", "max_bin", *[F.lit(None).cast("bigint").alias(c) for c in ("storage_tb", "n_tbs", "user_bin_id")])
    placed = table(spark, d, "layout_ub").filter("storage_tb IS NOT NULL AND n_tbs IS NOT NULL").distinct()
    rows = merged.unionByName(placed.withColumn("max_bin", F.lit(None).cast("bigint")))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        made = layout.Layout()
        for r in frame.itertuples(index=False):
            path = tuple(map(int, r.path))
            if pd.isna(r.max_bin):
                made.placed.append((path, int(r.storage_tb), int(r.n_tbs), int(r.user_bin_id)))
            elif path:
                made.merged.append((path, int(r.max_bin)))
            else:
                made.top_max_bin = int(r.max_bin)
        out = [
            (int(frame["batch_id"].iloc[0]), ";".join(map(str, n.path)), n.max_bin, len({r[2] for r in n.records}) or None, max((tb + w for tb, w, _ in n.records), default=None))
            for n in layout.nodes(layout.tree(made))
        ]
        names = ["batch_id", "path", "max_bin", "user_bins", "last_tb"]
        return pd.DataFrame(out, columns=names).astype({"user_bins": "Int64", "last_tb": "Int64"})

    return rows.groupBy("batch_id").applyInPandas(one, "batch_id bigint, path string, max_bin bigint, user_bins bigint, last_tb bigint")


def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return flat.split_chunks(supplier_parts(spark, d), 7)


QUERIES = {
    f.__name__: f
    for f in (sort_bins, size_intervals, layout_simple, layout_hierarchical, layout_with_unions, layout_fixtures, layout_round_trip, layout_lines, technical_bins, layout_graph, split_chunks)
}

_FULL = "SELECT DISTINCT batch_id, array_to_string(path, ';') AS path, storage_tb, n_tbs, user_bin_id, len(path) AS depth FROM layout_ub WHERE storage_tb IS NOT NULL AND n_tbs IS NOT NULL"

_PLACED = "SELECT row_number() OVER (ORDER BY l_suppkey) - 1 AS user_bin, 1::BIGINT AS times, true AS inside, true AS alone FROM (SELECT DISTINCT l_suppkey FROM lineitem)"

SQL = {
    "layout_simple": _PLACED,
    "layout_hierarchical": _PLACED,
    "layout_with_unions": _PLACED,
    "layout_fixtures": "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{entry}')" for name, (_, known) in _FIXTURES.items() for entry in known.split()) + ") t(fixture, entry)",
    "layout_round_trip": """
        SELECT * FROM (VALUES ('layouts', 2::BIGINT, true), ('config 3', 20, true), ('config 2', 20, true), ('config 1', 20, true)) t(what, n, same)
        UNION ALL SELECT 'lines', 2 * count(DISTINCT l_suppkey), true FROM lineitem
    """,
    "size_intervals": """
        WITH RECURSIVE o AS MATERIALIZED (
            SELECT n AS c, row_number() OVER (ORDER BY n DESC, user_bin_id) - 1 AS position
            FROM (SELECT user_bin_id, count(DISTINCT value) AS n FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL GROUP BY 1)
        ), cut(position, c, i) AS (
            SELECT position, c, 0::BIGINT FROM o WHERE position = 0
            UNION ALL SELECT position, c, i FROM (
                SELECT o.position, o.c, cut.i + 1 AS i, row_number() OVER (ORDER BY o.position) AS rn FROM cut JOIN o ON o.position > cut.position AND o.c < 0.5 * cut.c
            ) WHERE rn = 1
        )
        SELECT o.position, max(i) AS interval FROM o JOIN cut ON cut.position <= o.position GROUP BY 1
    """,
    "sort_bins": """
        SELECT user_bin_id, n AS cardinality, row_number() OVER (ORDER BY n DESC, user_bin_id) - 1 AS position
        FROM (SELECT user_bin_id, count(DISTINCT value) AS n FROM bins WHERE user_bin_id IS NOT NULL AND value IS NOT NULL GROUP BY 1)
    """,
    "layout_lines": f"""
        SELECT user_bin_id || chr(9) || (CASE WHEN depth > 0 THEN path || ';' ELSE '' END) || storage_tb || chr(9) || repeat('1;', depth) || n_tbs AS line FROM ({_FULL})
    """,
    "technical_bins": f"SELECT batch_id, coalesce(path, '') AS path, unnest(generate_series(storage_tb, storage_tb + n_tbs - 1)) AS bin, user_bin_id FROM ({_FULL})",
    "layout_graph": f"""
        WITH f AS ({_FULL}), s AS (SELECT batch_id, coalesce(path, '') AS path, count(DISTINCT user_bin_id) AS user_bins, max(storage_tb + n_tbs) AS last_tb FROM f GROUP BY 1, 2)
        SELECT m.batch_id, m.path, max_bin, user_bins, last_tb
        FROM (SELECT batch_id, coalesce(array_to_string(path, ';'), '') AS path, max_bin FROM layout_mb) m LEFT JOIN s USING (batch_id, path)
    """,
    "split_chunks": """
        SELECT user_bin_id, floor((rn - 1) / ceil(n / 7))::BIGINT AS part, value
        FROM (SELECT b AS user_bin_id, v AS value, row_number() OVER (PARTITION BY b ORDER BY v) AS rn, count(*) OVER (PARTITION BY b) AS n
              FROM (SELECT DISTINCT l_suppkey AS b, l_partkey AS v FROM lineitem))
    """,
}
