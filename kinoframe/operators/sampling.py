"""Sampling: which frames of a stream a selector keeps, on row counts, time grids and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.operators.scan import STREAM, ordered, packet_stats


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("_n", F.row_number().over(ordered())).where((F.col("_n") - 1) % n == 0).drop("_n")


def every_sec(frames: DataFrame, seconds: float) -> DataFrame:
    """The first frame, and each that enters a later cell of the grid anchored at it than all before."""
    step = max(int(seconds * 1_000_000), 1)
    w = ordered()
    p0 = F.first("pts_us").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cells = frames.withColumn("bucket", F.call_function("div", F.col("pts_us") - p0, F.lit(step)))
    before = F.max("bucket").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("bucket") > F.col("_before"))).drop("_before")


def keyframes_only(frames: DataFrame) -> DataFrame:
    return frames.where("is_key")


def uniform_n(frames: DataFrame, n: int) -> DataFrame:
    """``n`` frames a stream at the middles of n equal parts of its span: each target shows the frame on display then.

    Frame k is shown for the targets that are at or after it and before its successor; the count of targets below a
    stamp is a closed integer form, so no grid is joined. Targets past the last frame repeat it.
    """
    span = frames.groupBy(STREAM).agg(F.min("pts_us").alias("p0"), (F.max("pts_us") - F.min("pts_us")).alias("span"))
    rows = frames.join(span, STREAM)
    nxt = F.lead("pts_us").over(ordered())

    def below(t):
        # targets t_i = p0 + (2i+1) span / 2n with t_i < t: i < (2n (t - p0) - span) / 2 span
        top = (t - F.col("p0")) * (2 * n) - F.col("span")
        count = F.when(F.col("span") == 0, F.when(top > 0, n).otherwise(0)).otherwise(F.call_function("div", top + 2 * F.col("span") - 1, 2 * F.col("span")))
        return F.greatest(F.lit(0), F.least(F.lit(n), count))

    rows = rows.withColumn("_next", nxt)
    rows = rows.withColumn("_from", below(F.col("pts_us"))).withColumn("_to", F.coalesce(below(F.col("_next")), F.lit(n)))
    return rows.where("_to > _from").withColumn("target", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).drop("_next", "_from", "_to", "p0", "span")


def sampled_packet_stats(packets: DataFrame, seconds: float) -> DataFrame:
    """Statistics of each stream over a time grid: the flagship query."""
    return packet_stats(every_sec(packets, seconds))


def tumbling(packets: DataFrame, width_us: int) -> DataFrame:
    """Packets and bytes of each stream in windows anchored at its first stamp."""
    p0 = F.min("pts_us").over(Window.partitionBy(STREAM))
    cells = packets.withColumn("segment", F.call_function("div", F.col("pts_us") - p0, F.lit(width_us)))
    return cells.groupBy(STREAM, "segment").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))


def key_segments(packets: DataFrame, width_us: int) -> DataFrame:
    """Segment number of every packet when cuts fall on key packets alone.

    A key packet opens segment ``floor((pts - first) / width)`` if that is later than the segment it finds open, so the
    number is the running maximum over key packets.
    """
    p0 = F.min("pts_us").over(Window.partitionBy(STREAM))
    cell = F.when(F.col("is_key"), F.call_function("div", F.col("pts_us") - p0, F.lit(width_us))).otherwise(0)
    return packets.withColumn("_cell", cell).withColumn("segment", F.max("_cell").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("_cell")


def at_time(frames: DataFrame, t_us: int) -> DataFrame:
    """The first frame at or after a time since the stream's start; none where the stream ends before."""
    first = frames.groupBy(STREAM).agg(F.min("pts_us").alias("p0"))
    late = frames.join(first, STREAM).where(F.col("pts_us") - F.col("p0") >= t_us)
    return late.groupBy(STREAM).agg(F.min(F.struct("pts_us", "seq")).alias("f")).select(STREAM, F.col("f.pts_us").alias("pts_us"), F.col("f.seq").alias("seq"))


def at_index(frames: DataFrame, n: int) -> DataFrame:
    """Frame ``n`` (from 0) of each stream."""
    return frames.withColumn("_n", F.row_number().over(ordered())).where(F.col("_n") == n + 1).drop("_n")


def sprite_cells(frames: DataFrame, columns: int, rows: int, every: int) -> DataFrame:
    """Where every ``every``-th frame lands on sheets of columns x rows cells, row by row; the last may be partial."""
    n = (F.row_number().over(ordered()) - 1).cast("long")
    kept = every_nth(frames, every).withColumn("_n", n)
    return kept.select(
        STREAM,
        "seq",
        F.call_function("div", F.col("_n"), F.lit(columns * rows)).alias("sheet"),
        F.call_function("div", F.col("_n") % (columns * rows), F.lit(columns)).alias("row"),
        (F.col("_n") % columns).alias("col"),
    )
