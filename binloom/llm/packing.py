"""Filling fixed-capacity containers with items (problem 4).

Bounded-space online packing. A batch's items are dealt to chunks by hash and come
in blocks, in each of which the longest are first; a chunk keeps at most ``OPEN`` windows, puts each item into the window it fits
best, and when none fits opens another, emitting the fullest if there are too
many. What is still open at the end of the chunks is packed once more in the same
way, chunk by chunk, and so on until a batch's leftovers are one chunk, of which
nothing stays open. So no task has more than about ``CHUNK`` items or windows of
a batch at a time, and memory is the open windows, whatever the number of items.

An item longer than the capacity takes full containers and starts a window with
the rest of it, which other items may fill up; such a window never takes the
rest of a second long item, so a long item's containers stay consecutive.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from binloom.session import having, scratch, written

OPEN = 256
#: Open windows of a batch's last chunk.
OPEN_LAST = 4096
#: Items of a chunk, on average.
CHUNK = 50_000
#: Items of a block, on average; within a block the longest come first, as short ones fill gaps best at the end.
BLOCK = 1024


def items(data_store: DataFrame, bins: DataFrame) -> DataFrame:
    """(batch_id, user_bin_id, length): one row per item.

    Rows delivered twice are one. A missing ``kmer_counts`` is recovered as the
    number of distinct values of the user bin in the batch; 0 if it has none.
    Rows without user bin or batch are no items.
    """
    once = (
        data_store.filter(F.col("user_bin_id").isNotNull() & F.col("batch_id").isNotNull())
        .groupBy("batch_id", "user_bin_id")
        .agg(F.max("kmer_counts").alias("length"))
    )
    missing = once.filter(F.col("length").isNull()).select("batch_id", "user_bin_id")
    found = (
        having(bins.filter(F.col("value").isNotNull()).select("batch_id", "user_bin_id", "value"), missing)
        .distinct()
        .groupBy("batch_id", "user_bin_id")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return once.join(found, ["batch_id", "user_bin_id"], "left").select(
        "batch_id", "user_bin_id", F.coalesce("length", "found", F.lit(0)).cast("bigint").alias("length")
    )


class Windows:
    """The open windows of one chunk. ``sink`` gets (window, containers, start) of what is closed."""

    def __init__(self, capacity: int, most: int, sink) -> None:
        self.capacity, self.most, self.sink = capacity, most, sink
        self.free: dict[bool, list[tuple[int, int]]] = {False: [], True: []}  # by whether a long item is in it
        self.tbs: dict[int, int] = {}
        self.opened = self.next = 0

    def put(self, length: int, tbs: int = 1, long: bool = False) -> int:
        """Place ``length``; ``long`` with ``tbs`` containers of which it fills the last. Returns the window."""
        best = None
        for kind in (False, True):
            if kind and long:
                break
            at = bisect_left(self.free[kind], (length, -1))
            if at < len(self.free[kind]) and (best is None or self.free[kind][at] < best[0]):
                best = (self.free[kind][at], kind, at)
        if best is None:
            window, room = self.opened, self.capacity
            self.opened += 1
        else:
            (room, window), kind, at = best
            del self.free[kind][at]
        self.tbs[window] = max(tbs, self.tbs.get(window, 1))
        room -= length
        if room == 0:
            self.close(window)
        else:
            insort(self.free[self.tbs[window] > 1], (room, window))
            if len(self.tbs) > self.most:
                kind = min((k for k in self.free if self.free[k]), key=lambda k: self.free[k][0])
                self.close(self.free[kind].pop(0)[1])
        return window

    def close(self, window: int) -> None:
        tbs = self.tbs.pop(window)
        self.sink(window, tbs, self.next)
        self.next += tbs

    def left(self) -> list[tuple[int, int, int]]:
        """(window, fill, containers) of the windows still open."""
        return [(w, self.capacity - room, self.tbs[w]) for kind in self.free.values() for room, w in kind]


_OUT = "kind string, batch_id bigint, chunk int, win bigint, id bigint, fill bigint, tbs bigint, start bigint, part int"
_OUT_ARROW = pa.schema(
    [("kind", pa.string()), ("batch_id", pa.int64()), ("chunk", pa.int32()), ("win", pa.int64()), ("id", pa.int64()),
     ("fill", pa.int64()), ("tbs", pa.int64()), ("start", pa.int64()), ("part", pa.int32())]
)


def _packer(most: int, most_last: int):
    """Pack sorted (batch_id, chunk, capacity, last, id, length, tbs, part) rows, chunk after chunk.

    In later rounds ``part`` is the chunk that an open window comes from and
    ``id`` its number there. Of a chunk that is the ``last`` of its batch nothing
    stays open.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, windows, final, out = None, None, False, []

        def end() -> None:
            if windows is None:
                return
            if final:
                for window, _, _ in sorted(windows.left()):
                    windows.close(window)
                return
            out.extend(("open", *key, w, None, fill, tbs, None, None) for w, fill, tbs in windows.left())

        for batch in batches:
            names = ("batch_id", "chunk", "capacity", "last", "id", "length", "tbs", "part")
            for b, chunk, capacity, last, item, length, tbs, part in zip(*(batch.column(c).to_pylist() for c in names)):
                if (b, chunk) != key:
                    end()
                    key, final = (b, chunk), last
                    windows = Windows(capacity, most_last if last else most, lambda w, n, s, k=key: out.append(("close", *k, w, None, None, n, s, None)))
                window = windows.put(length, tbs, tbs > 1)
                out.append(("item", b, chunk, window, item, length, tbs, None, part))
            if len(out) > 5000:
                yield _rows(out)
                out.clear()
        end()
        if out:
            yield _rows(out)

    return pack


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT_ARROW)], schema=_OUT_ARROW)


def packed(things: DataFrame, capacities: DataFrame) -> DataFrame:
    """(batch_id, user_bin_id, length, storage_tb, n_tbs): where each item lies.

    Containers of a batch are numbered from 0 without gaps. ``n_tbs`` is above 1
    exactly for items longer than the capacity, which take ``storage_tb`` and
    those after it. Items of length 0 take no room. Items of a batch without a
    positive capacity have no place: both are null. Ties are settled by a hash
    of the id, so the result is the same in every run.
    """
    with scratch(things.sparkSession) as keep:
        return keep(written(_packed(things, capacities), "layout"))


def _packed(things: DataFrame, capacities: DataFrame) -> DataFrame:
    caps = capacities.groupBy("batch_id").agg(F.max("tb_capacity").alias("capacity")).filter("capacity > 0")
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("capacity"))).cast("bigint")
    items_ = things.join(caps, "batch_id").select(
        "batch_id",
        "capacity",
        F.col("user_bin_id").alias("id"),
        (F.col("length") - (n - 1) * F.col("capacity")).alias("length"),
        n.alias("tbs"),
        F.lit(None).cast("int").alias("part"),
    )
    rounds, last = [], False
    while not last:
        # Every chunk has some of all blocks, so there are as many blocks in a chunk as it can fill.
        sizes = items_.groupBy("batch_id").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("chunks"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")
        )
        first = not rounds
        own = ["part", "id"] if not first else ["id"]
        dealt = items_.join(sizes, "batch_id").select(
            "batch_id",
            F.pmod(F.xxhash64(*own), F.col("chunks")).cast("int").alias("chunk"),
            "capacity",
            # Items are packed again at least once; leftovers of one chunk are the end.
            (F.lit(not first) & (F.col("chunks") == 1)).alias("last"),
            "id",
            "length",
            "tbs",
            "part",
            # Leftovers are few: the longest come first throughout.
            (F.floor(F.pmod(F.xxhash64(*own, F.lit(2)), F.col("blocks")) / F.col("chunks")) if first else F.lit(0)).alias("block"),
        )
        order = [F.desc(F.col("tbs") > 1), F.desc("length"), F.xxhash64(*own, F.lit(1))]
        packed_ = dealt.repartition("batch_id", "chunk").sortWithinPartitions("batch_id", "chunk", "block", *order)
        rounds.append(written(packed_.mapInArrow(_packer(min(OPEN, CHUNK // 2), OPEN_LAST), _OUT), "packed"))
        # At most OPEN windows of each chunk: a few hundredths of the items or less.
        items_ = rounds[-1].filter("kind = 'open'").join(caps, "batch_id").select(
            "batch_id", "capacity", F.col("win").alias("id"), F.col("fill").alias("length"), "tbs", F.col("chunk").alias("part")
        )
        last = items_.isEmpty()

    closed = [r.filter("kind = 'close'").select(F.lit(i).alias("round"), "batch_id", "chunk", "win", "tbs", "start") for i, r in enumerate(rounds)]
    every = closed[0]
    for more in closed[1:]:
        every = every.unionByName(more)
    # One row per chunk: the numbering is a running sum over chunks, not items.
    totals = every.groupBy("batch_id", "round", "chunk").agg(F.sum("tbs").alias("tbs"))
    before = Window.partitionBy("batch_id").orderBy(F.desc("round"), "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("batch_id", "round", "chunk", F.coalesce(F.sum("tbs").over(before), F.lit(0)).alias("offset"))
    placed = every.join(offsets, ["batch_id", "round", "chunk"]).select(
        "round", "batch_id", "chunk", "win", "tbs", (F.col("start") + F.col("offset")).alias("start")
    )
    # Where the windows of a round lie: those closed in it, and those that the next round's windows took.
    places = None
    for number in range(len(rounds) - 1, -1, -1):
        here = placed.filter(F.col("round") == number).drop("round")
        if places is not None:
            took = rounds[number + 1].filter("kind = 'item'").select("batch_id", "chunk", "win", "part", F.col("id").alias("from"))
            here = here.unionByName(
                took.join(places, ["batch_id", "chunk", "win"]).select(
                    "batch_id", F.col("part").alias("chunk"), F.col("from").alias("win"), "tbs", "start"
                )
            )
        places = here
    laid = (
        rounds[0]
        .filter("kind = 'item'")
        .select("batch_id", "chunk", "win", F.col("id").alias("user_bin_id"), F.col("tbs").alias("n_tbs"))
        .join(places, ["batch_id", "chunk", "win"])
        .select(
            "batch_id",
            "user_bin_id",
            F.when(F.col("n_tbs") > 1, F.col("start")).otherwise(F.col("start") + F.col("tbs") - 1).alias("storage_tb"),
            "n_tbs",
        )
    )
    return things.join(laid, ["batch_id", "user_bin_id"], "left").select(
        "batch_id", "user_bin_id", "length", "storage_tb", "n_tbs"
    )


def fill(layout: DataFrame, capacities: DataFrame) -> DataFrame:
    """(batch_id, n_items, n_tbs, least_tbs, fill) of a layout: containers used and the least possible."""
    caps = capacities.groupBy("batch_id").agg(F.max("tb_capacity").alias("capacity"))
    return (
        layout.filter(F.col("n_tbs").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sum("length").alias("total"),
            F.max(F.col("storage_tb") + F.col("n_tbs")).alias("n_tbs"),
        )
        .join(caps, "batch_id")
        .select(
            "batch_id",
            "n_items",
            "n_tbs",
            F.ceil(F.col("total") / F.col("capacity")).alias("least_tbs"),
            F.round(F.col("total") / (F.col("n_tbs") * F.col("capacity")), 6).alias("fill"),
        )
    )


def checked(layout: DataFrame, capacities: DataFrame, slack: float = 0.02) -> DataFrame:
    """(batch_id, n_items, total, least_tbs, fits, gapless, split_only_long, tight) of a layout, from its rows alone.

    ``fits``: no container holds more than the capacity; ``gapless``: every
    container from 0 to the last holds something, items of length 0 aside;
    ``split_only_long``: an item has the least number of containers that hold it;
    ``tight``: containers beyond the least number are one, or ``slack`` of it.
    """
    caps = capacities.groupBy("batch_id").agg(F.max("tb_capacity").alias("capacity")).filter("capacity > 0")
    rows = layout.join(caps, "batch_id")
    whole = F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("capacity")))
    per_batch = rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("length").alias("total"),
        F.ceil(F.sum("length") / F.max("capacity")).alias("least_tbs"),
        F.max(F.col("storage_tb") + F.col("n_tbs")).alias("tbs"),
        F.bool_and(F.col("n_tbs") == whole).alias("split_only_long"),
    )
    # Full containers of long items hold nothing else; the last one of an item may.
    pieces = rows.select(
        "batch_id",
        "capacity",
        F.inline(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.col("n_tbs") - 1),
                lambda k: F.struct((F.col("storage_tb") + k).alias("tb"), F.least("capacity", F.col("length") - k * F.col("capacity")).alias("held")),
            )
        ),
    )
    loads = pieces.groupBy("batch_id", "capacity", "tb").agg(F.sum("held").alias("held"))
    per_tb = loads.groupBy("batch_id").agg(F.bool_and(F.col("held") <= F.col("capacity")).alias("fits"), F.count(F.lit(1)).alias("used"))
    extra = F.col("tbs") - F.col("least_tbs")
    return per_batch.join(per_tb, "batch_id").select(
        "batch_id",
        "n_items",
        "total",
        "least_tbs",
        "fits",
        (F.col("used") == F.col("tbs")).alias("gapless"),
        "split_only_long",
        ((extra <= 1) | (extra <= F.lit(slack) * F.col("least_tbs"))).alias("tight"),
    )
