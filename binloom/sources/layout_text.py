"""Layouts and configurations as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators.layout import Layout

# The line prefixes of layout files.
TOP = "#TOP_LEVEL_IBF"
LOWER = "#LOWER_LEVEL_IBF_"
FULLEST = "fullest_technical_bin_idx:"
COLUMNS = "#USER_BIN_IDX\tTECHNICAL_BIN_INDICES\tNUMBER_OF_TECHNICAL_BINS"


def _line(path, tb: int, n: int, user_bin: int) -> str:
    bins = ";".join(map(str, (*path, tb)))
    widths = ";".join(["1"] * len(path) + [str(n)])
    return f"{user_bin}\t{bins}\t{widths}"


def write_layout(layout: Layout) -> str:
    lines = [f"{TOP} {FULLEST}{layout.top_max_bin}"]
    lines += [f"{LOWER}{';'.join(map(str, path))} {FULLEST}{max_bin}" for path, max_bin in layout.merged]
    lines.append(COLUMNS)
    lines += [_line(*record) for record in layout.placed]
    return "\n".join(lines) + "\n"


def read_layouts(text: str) -> list[Layout]:
    """All layouts of a text; each begins with its own header, other lines before the first are skipped."""
    out: list[Layout] = []
    rows = False
    for number, line in enumerate(text.splitlines(), 1):
        if line.startswith(TOP):
            out.append(Layout(int(line.partition(FULLEST)[2])))
            rows = False
        elif not out or line.startswith("@") or not line:
            continue
        elif line.startswith(LOWER):
            path, _, max_bin = line.removeprefix(LOWER).partition(" ")
            out[-1].merged.append((tuple(map(int, path.split(";"))), int(max_bin.removeprefix(FULLEST))))
        elif line == COLUMNS:
            rows = True
        elif rows:
            try:
                user_bin, bins, widths = line.split("\t")
                *path, tb = map(int, bins.split(";"))
                out[-1].placed.append((tuple(path), tb, int(widths.split(";")[-1]), int(user_bin)))
            except ValueError:
                raise ValueError(f"line {number} is no layout line: {line!r}") from None
        else:
            raise ValueError(f"line {number} stands before the column names: {line!r}")
    return out


def read_layout(text: str) -> Layout:
    layouts = read_layouts(text)
    if not layouts:
        raise ValueError("no layout found")
    return layouts[0]


def layout_frames(spark: SparkSession, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(path, storage_tb, n_tbs, user_bin_id) and (path, max_bin), the top filter's path being empty."""
    placed = [(list(p), tb, n, ub) for p, tb, n, ub in layout.placed]
    merged = [([], layout.top_max_bin), *((list(p), m) for p, m in layout.merged)]
    return (
        spark.createDataFrame(placed, "path array<bigint>, storage_tb bigint, n_tbs bigint, user_bin_id bigint"),
        spark.createDataFrame(merged, "path array<bigint>, max_bin bigint"),
    )


def layout_of(placed: DataFrame, merged: DataFrame) -> Layout:
    """A layout from its two tables, which have a row per user bin and per filter; repeated rows count once."""
    out = Layout()
    for path, max_bin in sorted({(tuple(r[0]), r[1]) for r in merged.select("path", "max_bin").toLocalIterator()}):
        if path:
            out.merged.append((path, max_bin))
        else:
            out.top_max_bin = max_bin
    out.merged.sort(key=lambda m: len(m[0]))
    rows = placed.filter("storage_tb IS NOT NULL AND n_tbs IS NOT NULL").select("path", "storage_tb", "n_tbs", "user_bin_id").distinct()
    out.placed = sorted((tuple(r[0]), r[1], r[2], r[3]) for r in rows.toLocalIterator())
    return out


def layout_lines(placed: DataFrame) -> DataFrame:
    """(line): the body of a layout file, without the driver: a column expression per row."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    bins = F.array_join(F.concat(text(F.col("path")), F.array(F.col("storage_tb").cast("string"))), ";")
    widths = F.array_join(F.concat(F.transform("path", lambda _: F.lit("1")), F.array(F.col("n_tbs").cast("string"))), ";")
    return placed.select(F.concat_ws("\t", F.col("user_bin_id").cast("string"), bins, widths).alias("line"))


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(path, storage_tb, n_tbs, user_bin_id) of layout lines; header lines are skipped."""
    parts = F.split(F.col(column), "\t")
    numbers = lambda i: F.transform(F.split(parts[i], ";"), lambda x: x.cast("bigint"))
    rows = lines.filter(~F.col(column).startswith("#") & ~F.col(column).startswith("@") & (F.length(column) > 0))
    return rows.select(
        F.slice(numbers(1), F.lit(1), F.size(numbers(1)) - 1).alias("path"),
        F.element_at(numbers(1), -1).alias("storage_tb"),
        F.element_at(numbers(2), -1).alias("n_tbs"),
        parts[0].cast("bigint").alias("user_bin_id"),
    )


def technical_bins(placed: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, bin, user_bin_id): one row per technical bin a user bin is stored in."""
    full = placed.filter("storage_tb IS NOT NULL AND n_tbs IS NOT NULL").select(*keys, "path", "storage_tb", "n_tbs", "user_bin_id").distinct()
    return full.select(
        *keys, "path", F.explode(F.sequence("storage_tb", F.col("storage_tb") + F.col("n_tbs") - 1)).alias("bin"), "user_bin_id"
    )
