"""Session helpers: the shared folder and tables written into it.

Lineage is cut by writing a Parquet table into the folder that the cluster
names in ``spark.checkpoint.dir``. Unlike a cached or locally checkpointed
DataFrame such a table survives the loss of any executor, is computed once,
and later reads prune its columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set and there is one machine.

    On a cluster a folder of one machine would lose rows, so there it is an
    error that none is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="binloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back. Stays until :func:`forget`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/binloom-{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._binloom_path = path
    return back


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the tables behind ``frames``; without frames, all this session wrote."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    paths = [getattr(f, "_binloom_path", None) for f in frames] if frames else list(mine)
    _delete(spark, [p for p in paths if p in mine])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written[spark.sparkContext.applicationId].remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written in its block, but for those handed to what it yields."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    before, kept = set(mine), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._binloom_path)
        return df

    try:
        yield keep
    finally:
        _delete(spark, [p for p in mine if p not in before and p not in kept])


#: Keys that are sent to all executors; 8 MiB of numbers.
KEYS = 1_000_000


def having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose columns of ``keys`` are in it.

    Up to ``KEYS`` keys are broadcast, so ``df`` is not shuffled, nor its hot
    keys brought together; beyond that it is a shuffled join, whose long
    partitions adaptive execution splits.
    """
    once = written(keys.distinct(), "keys")
    side = F.broadcast(once) if once.count() <= KEYS else once
    return df.join(side, keys.columns, "left_semi")


def parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle makes before adaptive execution coalesces them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy per row.

    A table of one small file is one partition and would be one task; large
    inputs come in many partitions and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
