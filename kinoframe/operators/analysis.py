"""Detector events and reports: pairing starts with ends, tails, summaries, colour routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.operators.scan import STREAM, ordered, upto

BT2020 = ("bt2020nc", "bt2020c", "bt2020ncl", "bt2020cl")
PQ, HLG = "smpte2084", "arib-std-b67"


def islands(frames: DataFrame, hit: Column, least_us: int, frame_us: int) -> DataFrame:
    """Ranges of consecutive frames for which ``hit`` holds, of at least ``least_us``; the last one ends with the stream.

    A range ends where the first frame after it begins; an open one ends at its last stamp plus a frame.
    """
    w = ordered()
    marked = frames.withColumn("_hit", hit).withColumn("_next", F.lead("pts_us").over(w)).withColumn("_run", F.sum(F.when(hit, 0).otherwise(1)).over(upto(w)))
    ranges = marked.where("_hit").groupBy(STREAM, "_run").agg(F.min("pts_us").alias("start_us"), F.max(F.coalesce("_next", F.col("pts_us") + frame_us)).alias("end_us"))
    return ranges.where(F.col("end_us") - F.col("start_us") >= least_us).select(STREAM, "start_us", "end_us")


def paired(events: DataFrame, stream_end_us: Column, least_us: int) -> DataFrame:
    """(stream, channel) start events matched with end events, the first pending one first; what is open ends with the stream.

    ``events``: (stream_index, channel, seq, kind 'start' or 'end', pts_us). An end without a pending start is dropped:
    the k-th accepted end of a channel belongs to its k-th start, where ends are accepted while starts lead them.
    """
    w = Window.partitionBy(STREAM, "channel").orderBy("seq")
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    rows = events.withColumn("_sum", F.sum(step).over(upto(w)))
    # a walk that would go below zero is lifted: ends that do so are the ones without a start
    rows = rows.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto(w))))
    before = F.coalesce(F.lag("_low").over(w), F.lit(0))
    rows = rows.withColumn("_orphan", (F.col("kind") == "end") & (F.col("_low") < before))
    rows = rows.where("not _orphan").withColumn("_k", F.row_number().over(Window.partitionBy(STREAM, "channel", "kind").orderBy("seq")))
    starts = rows.where("kind = 'start'").select(STREAM, "channel", "_k", F.col("pts_us").alias("start_us"))
    ends = rows.where("kind = 'end'").select(STREAM, "channel", "_k", F.col("pts_us").alias("end_us"))
    out = starts.join(ends, [STREAM, "channel", "_k"], "left").withColumn("end_us", F.coalesce("end_us", stream_end_us))
    return out.where(F.col("end_us") - F.col("start_us") >= least_us).drop("_k")


def scenes(frames: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Frames whose score against the frame before reaches the threshold."""
    return frames.withColumn("score", score).where(F.col("score") >= threshold).select(STREAM, F.col("pts_us").alias("at_us"), "score")


def last_known(frames: DataFrame, *columns: str) -> DataFrame:
    """The last value that is not null of each column, a row a stream."""
    return frames.groupBy(STREAM).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns])


def crop(frames: DataFrame) -> DataFrame:
    """The last complete crop rectangle of each stream."""
    whole = frames.where("x is not null and y is not null and w is not null and h is not null")
    return whole.groupBy(STREAM).agg(F.max(F.struct("seq", "x", "y", "w", "h")).alias("c")).select(STREAM, "c.x", "c.y", "c.w", "c.h")


def report(ranges: DataFrame, scene_rows: DataFrame) -> DataFrame:
    """Per stream: number and total length of its ranges, number of scenes and the best score."""
    a = ranges.groupBy(STREAM).agg(F.count(F.lit(1)).alias("ranges"), F.sum(F.col("end_us") - F.col("start_us")).alias("ranges_us"))
    b = scene_rows.groupBy(STREAM).agg(F.count(F.lit(1)).alias("scenes"), F.max("score").alias("best_score"))
    return a.join(b, STREAM, "full").select(STREAM, F.coalesce("ranges", F.lit(0)).alias("ranges"), F.coalesce("ranges_us", F.lit(0)).alias("ranges_us"), F.coalesce("scenes", F.lit(0)).alias("scenes"), "best_score")


def is_hdr(space: Column, transfer: Column, primaries: Column) -> Column:
    return F.coalesce(space.isin(*BT2020), F.lit(False)) | F.coalesce(primaries == "bt2020", F.lit(False)) | F.coalesce(transfer.isin(PQ, HLG), F.lit(False))


def guessed_space(height: Column) -> Column:
    return F.when(height >= 720, "bt709").otherwise("bt601")


def colour_kind(space: Column, transfer: Column, primaries: Column) -> Column:
    """Route of a frame: by transfer first, then by gamut."""
    wide = F.coalesce(space.isin(*BT2020), F.lit(False)) | F.coalesce(primaries == "bt2020", F.lit(False))
    return F.when(transfer == PQ, "pq").when(transfer == HLG, "hlg").when(wide, "wide_gamut_sdr").otherwise("sdr")


def loudness(samples: DataFrame) -> DataFrame:
    """Peak and mean square of each chunk and stream, from the samples: our own plain measure."""
    square = F.aggregate("data", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    peak = F.array_max(F.transform("data", lambda x: F.abs(x.cast("double"))))
    return samples.select("asset_id", "index", "pts_us", peak.alias("peak"), (square / F.size("data")).alias("mean_square"))


def windowed_loudness(samples: DataFrame, chunks_back: int) -> DataFrame:
    """Mean square over a sliding window of chunks, as momentary and short-term loudness use."""
    w = Window.partitionBy("asset_id").orderBy("index").rowsBetween(-(chunks_back - 1), 0)
    return loudness(samples).withColumn("window_mean", F.avg("mean_square").over(w))
