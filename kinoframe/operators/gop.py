"""Groups of pictures: numbering, statistics, retention, replay."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.operators.scan import STREAM, from_first_key, ordered, upto
from kinoframe.operators.scans import CELL, scanned
from kinoframe.scratch import cut


def with_gop(packets: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """Packets with ``gop_id`` from 0: a key packet opens a new group unless it is the first packet of its stream.

    A stream is counted in cells of ``cell`` sequence numbers, after the key packets of the cells before, so that a long
    stream is not one task.
    """
    rows = packets.withColumn("_cell", F.call_function("div", "seq", F.lit(cell)))
    w = Window.partitionBy(STREAM).orderBy("_cell")
    cells = rows.groupBy(STREAM, "_cell").agg(F.count_if("is_key").alias("_keys"), F.min(F.struct("seq", "is_key")).alias("_first"))
    before = F.coalesce(F.sum("_keys").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(STREAM, "_cell", (before - F.first("_first.is_key").over(upto(w)).cast("long")).alias("_before"))
    own = F.sum(F.col("is_key").cast("long")).over(upto(Window.partitionBy(STREAM, "_cell").orderBy("seq")))
    return rows.join(cells, [STREAM, "_cell"]).withColumn("gop_id", F.col("_before") + own).drop("_cell", "_before")


def gop_stats(packets: DataFrame) -> DataFrame:
    """Frames, bytes and whether there is a key packet, of each group."""
    return with_gop(packets).groupBy(STREAM, "gop_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"), F.bool_or("is_key").alias("has_key"))


def retained(packets: DataFrame, most: int) -> DataFrame:
    """Packets that a cache of ``most`` closed groups and the open one holds at the end of each stream; without room for a
    closed group nothing is cached. Groups are numbered without gaps, so the greatest tells."""
    numbered = with_gop(packets)
    last = F.max("gop_id").over(Window.partitionBy(STREAM))
    return numbered.withColumn("_last", last).where((F.col("gop_id") >= F.col("_last") - most) & F.lit(most > 0)).drop("_last")


def replay_suffix(packets: DataFrame, budget: int) -> DataFrame:
    """The longest run of last groups whose bytes fit in the budget, with the bytes from each group to the end."""
    stats = gop_stats(packets)
    w = Window.partitionBy(STREAM).orderBy(F.col("gop_id").desc())
    return stats.withColumn("suffix_bytes", F.sum("bytes").over(upto(w))).where(F.col("suffix_bytes") <= budget)


def gated(packets: DataFrame) -> DataFrame:
    """What a watcher gets that joins at the start: nothing of a stream before its first key packet."""
    return from_first_key(packets)


def bounded(packets: DataFrame, most_frames: int) -> DataFrame:
    """What a cache keeps of groups that grow past ``most_frames`` packets: the packet too many clears the open group, itself
    with it, and counting begins anew. So of each group the last run stays, if it is not full."""
    numbered = with_gop(packets)
    w = Window.partitionBy(STREAM, "gop_id")
    run = most_frames + 1
    rows = numbered.withColumn("_at", F.row_number().over(w.orderBy("seq")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where(F.col("_at") >= F.col("_n") - F.col("_n") % run).drop("_at", "_n")


@dataclass
class Open:
    """The open group: its number, its run (a cleared group goes on as another), and what it holds. Numbers are only counted on."""

    group: int = field(default=0, compare=False)
    run: int = field(default=0, compare=False)
    count: int = 0
    size: int = 0

    def take(self, is_key: bool, size: int, frames: int, most: int) -> tuple[int, int, int]:
        """A packet's group and run, and the run that goes on after it."""
        if is_key and self.count:
            self.group, self.count, self.size = self.group + 1, 0, 0
        self.count, self.size, run = self.count + 1, self.size + size, self.run
        if self.count > frames or self.size > most:
            self.run, self.count, self.size = run + 1, 0, 0
        return self.group, run, self.run


def moved(entry: Open, left: Open, state: Open) -> Open:
    """What a cell that leaves ``left`` from ``entry`` leaves from a state that may differ in its numbers."""
    return Open(left.group + state.group - entry.group, left.run + state.run - entry.run, left.count, left.size)


def cached(packets: DataFrame, groups: int, frames: int = 4096, size: int = 64 << 20, cell: int = CELL) -> DataFrame:
    """Packets that a cache of ``groups`` closed groups and the open one holds at the end of each stream, with ``group``.

    A key packet closes the open group unless that is empty; a packet that takes it past ``frames`` packets or ``size`` bytes
    clears it, itself with it.
    """
    rows = scanned(packets, [STREAM], ["is_key", "size"], Open, lambda o, key, n: o.take(bool(key), n or 0, frames, size), "group long, _run long, _after long", cell=cell, moved=moved)
    rows = cut(rows)
    last = rows.groupBy(STREAM, "group").agg(F.max("_after").alias("_stays")).select(F.col(STREAM).alias("_stream"), F.col("group").alias("_group"), "_stays")
    last = last.withColumn("_last", F.max("_group").over(Window.partitionBy("_stream")))
    out = rows.join(last, rows[STREAM].eqNullSafe(last["_stream"]) & (rows["group"] == last["_group"]))
    return out.where((F.col("_run") == F.col("_stays")) & (F.col("group") >= F.col("_last") - groups) & F.lit(groups > 0)).drop("_run", "_after", "_stream", "_group", "_stays", "_last")


def serving_prefix(packets: DataFrame) -> DataFrame:
    """Bytes queued to each stream's connection ahead of every packet."""
    ahead = F.sum("size").over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    return packets.withColumn("ahead_bytes", F.coalesce(ahead, F.lit(0)))
