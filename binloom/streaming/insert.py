"""Inserting values into a filter from a stream.

Each micro-batch is turned into words and OR-ed with what earlier batches left.
The state is a table of words, one version per batch in the given folder; a
version is written whole before the next batch starts and a batch that is
repeated after a failure rewrites its own version, so every value counts once
however often it is delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from binloom.operators import flat

#: Versions kept besides the newest.
KEPT = 2


class WordStore:
    """The words of a filter that grows with a stream."""

    def __init__(self, spark: SparkSession, path: str, bins: int, bin_size: int, functions: int = 2) -> None:
        flat.check_shape(bins, bin_size, functions)
        self.spark, self.path = spark, path.rstrip("/")
        self.bins, self.bin_size, self.functions = bins, bin_size, functions

    def _folder(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._folder()
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.startswith("batch=") and fs.exists(at.suffix(f"/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={version}")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """OR a batch of (user_bin_id, value) into the words; the sink for ``foreachBatch``."""
        empty = flat.Filter(self.bins, self.bin_size, self.functions, None)
        words = flat.words_of(flat._rows(batch, empty.bins, empty.bin_size), self.functions)
        earlier = [v for v in self.versions() if v < batch_id]
        if earlier:
            words = words.unionByName(self._read(earlier[-1])).groupBy("ibf_id", "pos", "word_idx").agg(F.bit_or("word").alias("word"))
        words.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        at, fs = self._folder()
        for old in earlier[: -KEPT or None]:
            fs.delete(at.suffix(f"/batch={old}"), True)

    def current(self) -> flat.Filter:
        found = self.versions()
        if not found:
            raise ValueError("nothing has been inserted yet")
        return flat.Filter(self.bins, self.bin_size, self.functions, self._read(found[-1]))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Insert a stream of (user_bin_id, value)."""
        writer = stream.select("user_bin_id", "value").writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
