"""Composite jobs: segment ladders, concatenation, fan-out to renditions, format negotiation, colour policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions import text
from kinoframe.operators import sampling
from kinoframe.operators.scan import STREAM

#: Most renditions a ladder may have; they are literals of the plan, so no table is broadcast for them.
MOST_RENDITIONS = 32


def fanned_out(frames: DataFrame, renditions: list[tuple[str, int, int, int]]) -> DataFrame:
    """Every frame once a rendition (name, width, height, video bits a second): an explode of a literal array."""
    if not 0 < len(renditions) <= MOST_RENDITIONS:
        raise ValueError(f"a ladder has 1 to {MOST_RENDITIONS} renditions")
    table = F.array(*[F.struct(F.lit(n).alias("rendition"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(b).cast("long").alias("bps")) for n, w, h, b in renditions])
    return frames.select("*", F.inline(table))


def ladder(packets: DataFrame, renditions: list[tuple[str, int, int, int]], segment_us: int) -> DataFrame:
    """Segments of each rendition of each stream: number, packets, span, and the bytes a rendition's rate gives it.

    Segments are cut at key packets. They are counted once a stream, before renditions multiply the rows.
    """
    cut = sampling.key_segments(packets, segment_us)
    segments = cut.groupBy(STREAM, "segment").agg(F.count(F.lit(1)).alias("packets"), F.min("pts_us").alias("start_us"), F.max("pts_us").alias("last_us"))
    out = fanned_out(segments, renditions)
    span, unit = F.col("last_us") - F.col("start_us"), F.lit(8_000_000)
    # whole units first: a rate times a span in microseconds outgrows a long after some weeks
    return out.withColumn("bytes", F.col("bps") * F.call_function("div", span, unit) + F.call_function("div", F.col("bps") * (span % unit), unit))


def ladder_playlists(streams: DataFrame, renditions: list[tuple[str, int, int, int]], audio_bps: int = 128_000, version: int = 3) -> DataFrame:
    """A master playlist a stream: its renditions by bandwidth."""
    rows = fanned_out(streams.select(F.col(STREAM).alias("asset_id")), renditions)
    rows = rows.withColumn("bandwidth", text.bandwidth(F.col("bps"), F.lit(audio_bps))).withColumn("uri", F.concat("rendition", F.lit("/index.m3u8")))
    return text.master_playlist(rows, version)


def concatenated(packets: DataFrame, durations: DataFrame) -> DataFrame:
    """Packets of segments (asset_id, part) one after another: each is moved by the durations of the parts before it.

    ``durations``: (asset_id, part, duration_us), a row a part.
    """
    before = Window.partitionBy("asset_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durations.select("asset_id", "part", F.coalesce(F.sum("duration_us").over(before), F.lit(0)).alias("_offset"))
    return packets.join(offsets, ["asset_id", "part"]).withColumn("out_us", F.col("pts_us") + F.col("_offset")).drop("_offset")


def negotiated(wanted: Column, asked: Column, producible: list[str]) -> Column:
    """Formats a graph may put out: the one asked for, else the encoder's list; of those, what can be made."""
    offer = F.when(asked.isNotNull(), F.array(asked)).otherwise(wanted)
    return F.array_intersect(offer, F.array(*[F.lit(p) for p in producible]))


def colour_tags(space: Column, height: Column, policy: str = "guess", forced: str | None = None) -> Column:
    """A frame's matrix under a policy: ``tagged`` keeps what is there, ``guess`` fills by the height, ``force`` replaces."""
    if policy == "force":
        return F.lit(forced)
    tag = F.when(space != "unspecified", space)
    return tag if policy == "tagged" else F.coalesce(tag, F.when(height >= 720, "bt709").otherwise("bt601"))


def rotation_degrees(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Clockwise rotation in whole degrees (0 to 359) of a display matrix's first two rows (a b; c d), 16.16 fixed point.

    Null for a matrix without a direction.
    """
    x, y = F.hypot(a.cast("double"), c.cast("double")), F.hypot(b.cast("double"), d.cast("double"))
    turn = F.degrees(F.atan2(b.cast("double") / y, a.cast("double") / x))
    return F.when((x > 0) & (y > 0), F.pmod(F.round(turn).cast("int") + 360, F.lit(360)))


def thumbnails(frames: DataFrame, percents: list[float]) -> DataFrame:
    """Of each stream, the first frame at or after each share of its duration."""
    span = frames.groupBy(STREAM).agg(F.min("pts_us").alias("_p0"), F.max("pts_us").alias("_p1"))
    at = F.array(*[F.struct(F.lit(float(p)).alias("percent"), (F.col("_p0") + ((F.col("_p1") - F.col("_p0")) * F.lit(float(p)) / 100).cast("long")).alias("at_us")) for p in percents])
    targets = span.select(STREAM, F.inline(at))
    hit = frames.join(targets, STREAM).where("pts_us >= at_us")
    return hit.groupBy(STREAM, "percent").agg(F.min(F.struct("pts_us", "seq")).alias("f")).select(STREAM, "percent", F.col("f.seq").alias("seq"), F.col("f.pts_us").alias("pts_us"))


def frame_events(frames: DataFrame) -> DataFrame:
    """Typed events of frames' metadata maps (string to string): scene changes, complete crops and loudness.

    One scan: each frame gives an array of the events it holds, which is exploded.
    """
    get = lambda key: F.try_element_at("metadata", F.lit(key))
    num = lambda key: get(key).try_cast("double")
    crop = [get(f"crop.{k}").try_cast("long") for k in ("x", "y", "w", "h")]
    whole = F.lit(True)
    for c in crop:
        whole &= c.isNotNull()
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    found = F.array(
        F.when(num("scene.time").isNotNull(), event("scene", F.coalesce(num("scene.score"), F.lit(0.0)))),
        F.when(whole, event("crop", crop[2] * crop[3])),
        F.when(num("loudness.integrated").isNotNull() | num("loudness.range").isNotNull(), event("loudness", num("loudness.integrated"))),
    )
    return frames.select(STREAM, "seq", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")).select(STREAM, "seq", "e.kind", "e.value")


def chained(frames: DataFrame, *steps) -> DataFrame:
    """A pipeline of DataFrame functions in order; Spark plans the whole of it as one."""
    for step in steps:
        frames = frames.transform(step)
    return frames


def discarded(df: DataFrame) -> None:
    """Runs a plan to its end and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
