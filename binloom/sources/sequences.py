"""Sequence files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.session import written


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, text): one row per record; lines of a sequence are joined.

    Files are split among tasks at a ``>`` that begins a line.
    """
    raw = spark.read.text(paths, lineSep="\n>").select(F.input_file_name().alias("file"), "value")
    first = F.substring_index("value", "\n", 1)
    rest = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    name = F.regexp_replace(F.trim(F.regexp_replace(first, r"\r$", "")), r"^\s*>", "")
    records = raw.filter(F.length(F.trim(F.regexp_replace("value", r"^\s*>?\s*$", ""))) > 0)
    return records.select("file", F.trim(name).alias("name"), F.regexp_replace(rest, r"\s", "").alias("text"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, text) of records of four lines.

    Lines are numbered within the block of the file that a task reads, and the
    numbers of lines in earlier blocks are added, so files are split among tasks.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value"
    )
    lines = written(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    at = F.col("i") + F.col("offset")
    numbered = lines.join(offsets, ["file", "block"]).select(
        "file", F.floor(at / 4).alias("record"), (at % 4).alias("part"), F.regexp_replace("value", r"\r$", "").alias("value")
    )
    return (
        numbered.filter("part < 2")
        .groupBy("file", "record")
        .agg(F.max(F.when(F.col("part") == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("part") == 1, F.col("value"))).alias("text"))
        .filter(F.length("name") > 1)
        .select("file", F.expr("substring(name, 2)").alias("name"), "text")
    )


def is_fastq(path: str) -> bool:
    return path.removesuffix(".gz").lower().endswith((".fq", ".fastq"))


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of files of either kind, each kind in one scan."""
    paths = [paths] if isinstance(paths, str) else paths
    kinds = [(read_fastq, [p for p in paths if is_fastq(p)]), (read_fasta, [p for p in paths if not is_fastq(p)])]
    frames = [read(spark, some) for read, some in kinds if some]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def read_numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(bin, name, text): the records of all files; ``bin`` is a file's place in the list.

    A file given more than once makes a bin of each of its places.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def whole(path: str) -> str:
        at = path_of(path)
        return at.getFileSystem(hadoop).makeQualified(at).toUri().getPath()

    places = spark.createDataFrame([(whole(p), i) for i, p in enumerate(paths)], "path string, bin bigint")
    texts = read_sequences(spark, sorted(set(paths)))
    path = F.url_decode(F.regexp_replace(F.regexp_replace("file", r"\+", "%2B"), r"^[a-z0-9]+:(?://[^/]*)?(?=/)", ""))
    return texts.withColumn("path", path).join(places, "path").select("bin", "name", "text")


def write_tsv(rows: DataFrame, path: str, *header: str) -> None:
    """Tab-separated files with a header line that begins with ``#``."""
    named = rows.toDF(*["#" + header[0], *header[1:]])
    named.write.mode("overwrite").option("header", True).option("sep", "\t").option("comment", "\u0002").option("emptyValue", "").csv(path)
