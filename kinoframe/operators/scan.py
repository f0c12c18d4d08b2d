"""Packet inspection and input control: statistics, seeks, trims, loops, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions.rational import scaled_ts

STREAM = "stream_index"


def ordered(*by: str) -> Window:
    return Window.partitionBy(STREAM).orderBy(*(by or ("seq",)))


def upto(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def packet_stats(packets: DataFrame) -> DataFrame:
    """Packets, key packets, bytes and the time range of each stream: one partial aggregate, one shuffle."""
    return packets.groupBy(STREAM).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("is_key").alias("keyframes"),
        F.sum("size").alias("bytes"),
        F.min("pts_us").alias("min_pts_us"),
        F.max("pts_us").alias("max_pts_us"),
    )


def durations(packets: DataFrame, frame_us: int) -> DataFrame:
    """Each stream's duration: from its first stamp to the end of its last packet."""
    return packets.groupBy(STREAM).agg((F.max("pts_us") + frame_us - F.min("pts_us")).alias("duration_us"))


def seek_floor(packets: DataFrame, at_us: int) -> DataFrame:
    """Packets from the last key packet at or before ``at_us`` on (all, where there is none), re-zeroed at it."""
    floor = packets.where(F.col("is_key") & (F.col("pts_us") <= at_us)).groupBy(STREAM).agg(F.max("pts_us").alias("floor_us"))
    start = packets.groupBy(STREAM).agg(F.min("pts_us").alias("first_us")).join(floor, STREAM, "left").select(STREAM, F.coalesce("floor_us", "first_us").alias("floor_us"))
    return packets.join(start, STREAM).where("pts_us >= floor_us").withColumn("out_us", F.col("pts_us") - F.col("floor_us"))


def first_keyframe(packets: DataFrame) -> DataFrame:
    """The first key packet of each stream."""
    return packets.where("is_key").groupBy(STREAM).agg(F.min(F.struct("seq", "pts_us")).alias("k")).select(STREAM, F.col("k.seq").alias("seq"), F.col("k.pts_us").alias("pts_us"))


def trimmed(packets: DataFrame, start_us: int | None, duration_us: int | None = None, stop_us: int | None = None) -> DataFrame:
    """Packets of a time range, re-zeroed at its start; a stop time replaces the duration."""
    if stop_us is not None:
        if stop_us <= (start_us or 0):
            raise ValueError("the stop time must lie after the start time")
        duration_us = stop_us - (start_us or 0)
    begin = start_us or 0
    out = packets.where(F.col("pts_us") >= begin)
    if duration_us is not None:
        out = out.where(F.col("pts_us") < begin + duration_us)
    return out.withColumn("out_us", F.col("pts_us") - begin)


def looped(packets: DataFrame, times: int) -> DataFrame:
    """A stream played ``times`` more: each pass is shifted by the range of stamps of the stream."""
    span = packets.groupBy(STREAM).agg((F.max("pts_us") - F.min("pts_us")).alias("span_us"))
    passes = packets.join(span, STREAM).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times))))
    return passes.withColumn("out_us", F.col("pts_us") + F.col("pass") * F.col("span_us"))


def rescaled(packets: DataFrame, scale: float) -> DataFrame:
    return packets.withColumn("out_us", scaled_ts(F.col("pts_us"), scale))


def forced_rate(packets: DataFrame, num: int, den: int) -> DataFrame:
    """Packets restamped on a constant grid: tick n of den/num for the n-th packet of a stream."""
    return packets.withColumn("tick", (F.row_number().over(ordered()) - 1).cast("long")).withColumn("out_us", F.call_function("div", F.col("tick") * (1_000_000 * den), F.lit(num)))


def paced(packets: DataFrame, rate: float, burst_us: int = 500_000) -> DataFrame:
    """When each packet may leave: its time since the stream's first, less the burst, at ``rate`` times real time."""
    first = F.min("pts_us").over(Window.partitionBy(STREAM))
    return packets.withColumn("due_us", F.greatest(F.lit(0), ((F.col("pts_us") - first - burst_us) / F.lit(float(rate))).cast("long")))


def without_corrupt(packets: DataFrame) -> DataFrame:
    return packets.where(~F.col("is_corrupt"))


def error_runs(packets: DataFrame, limit: int) -> DataFrame:
    """Decoding stops at the first packet that makes more than ``limit`` errors in a row; what comes before it."""
    good = F.sum(F.when(F.col("is_corrupt"), 0).otherwise(1)).over(upto(ordered()))
    marked = packets.withColumn("_good", good)
    in_row = F.sum(F.col("is_corrupt").cast("int")).over(upto(Window.partitionBy(STREAM, "_good").orderBy("seq")))
    marked = marked.withColumn("errors_in_row", in_row.cast("long")).drop("_good")
    stop = F.max((F.col("errors_in_row") > limit).cast("int")).over(upto(ordered()))
    return marked.withColumn("_stop", stop).where("_stop = 0").drop("_stop")


def copy_window(packets: DataFrame, start_us: int, duration_us: int) -> DataFrame:
    """Stream copy: from the first key packet at or after the start, to the end of the time range, re-zeroed."""
    inside = packets.where((F.col("pts_us") >= start_us) & (F.col("pts_us") < start_us + duration_us))
    return from_first_key(inside).withColumn("out_us", F.col("pts_us") - start_us)


def from_first_key(packets: DataFrame) -> DataFrame:
    """Each stream from its first key packet on: an aggregate and a join, so that a stream's packets need not meet."""
    first = packets.where("is_key").groupBy(STREAM).agg(F.min("seq").alias("_from"))
    return packets.join(first, STREAM).where("seq >= _from").drop("_from")


def keep_media(streams: DataFrame, *, video: bool = True, audio: bool = True, subtitle: bool = True, data: bool = True) -> DataFrame:
    """Streams less the media types that are switched off."""
    off = [k for k, on in (("video", video), ("audio", audio), ("subtitle", subtitle), ("data", data)) if not on]
    return streams.where(~F.col("kind").isin(off)) if off else streams


def limit_each(packets: DataFrame, n: int, by: Column | str = "seq") -> DataFrame:
    """The first ``n`` packets of each stream."""
    return packets.withColumn("_n", F.row_number().over(Window.partitionBy(STREAM).orderBy(by))).where(F.col("_n") <= n).drop("_n")
