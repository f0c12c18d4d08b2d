"""PCM: concatenation, re-framing, mixing and rate conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collected(chunks: DataFrame) -> DataFrame:
    """An asset's chunks as one array in chunk order, with how many layouts it has (1 is what a whole needs)."""
    data = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "data"))), lambda x: x.data))
    return chunks.groupBy("asset_id").agg(data.alias("data"), F.count_distinct("sample_rate", "channels").alias("layouts"))


def reframed(chunks: DataFrame, size: int) -> DataFrame:
    """Samples dealt anew into frames of ``size``: the last may be shorter. No row holds more than a frame."""
    w = Window.partitionBy("asset_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    at = chunks.withColumn("_start", F.coalesce(F.sum(F.size("data")).over(w), F.lit(0)))
    one = at.select("asset_id", "_start", F.posexplode("data").alias("_i", "x")).withColumn("_n", F.col("_start") + F.col("_i"))
    frame = F.call_function("div", F.col("_n"), F.lit(size))
    rows = one.groupBy("asset_id", frame.alias("frame")).agg(F.array_sort(F.collect_list(F.struct("_n", "x"))).alias("s"))
    return rows.select("asset_id", "frame", F.transform("s", lambda v: v.x).alias("data"))


def mixed_down(chunks: DataFrame, channels: int) -> DataFrame:
    """Interleaved frames as mono: the mean of each frame's channels."""
    frames = F.sequence(F.lit(0), F.call_function("div", F.size("data"), F.lit(channels)).cast("int") - 1)
    mono = F.transform(frames, lambda i: F.aggregate(F.slice("data", i * channels + 1, channels), F.lit(0.0).cast("double"), lambda a, x: a + x) / channels)
    return chunks.withColumn("data", mono).withColumn("channels", F.lit(1))


def as_s16(chunks: DataFrame) -> DataFrame:
    """Samples as 16-bit whole numbers, rounded and clipped."""
    return chunks.withColumn("data", F.transform("data", lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(x.cast("double") * 32768).cast("int")))))


def placed(chunks: DataFrame) -> DataFrame:
    """Chunks with ``start``, ``total`` (samples before them and of their asset) and ``after`` (the sample that follows, for
    the last chunk its own last). Only sizes and first samples are gathered by asset, never the samples."""
    w = Window.partitionBy("asset_id").orderBy("index")
    ends = chunks.where(F.size("data") > 0).select("asset_id", "index", F.size("data").alias("_n"), F.element_at("data", 1).alias("_first"), F.element_at("data", -1).alias("_last"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("asset_id"))
    places = ends.select("asset_id", "index", before.alias("start"), total.alias("total"), F.coalesce(F.lead("_first").over(w), "_last").alias("after"))
    return chunks.join(places, ["asset_id", "index"])


def resampled(chunks: DataFrame, rate: int) -> DataFrame:
    """Chunks at another rate by linear interpolation, each with ``first``, the place of its first new sample in the asset.

    A chunk makes the new samples that fall on it or between it and the next one, whose first sample is at hand, so chunks
    are worked on apart. An asset of n samples gets n * rate / its rate, rounded down; chunks that get none are left out.
    """
    old = F.col("sample_rate").cast("long")
    upward = lambda n: F.call_function("div", n * rate + old - 1, old)
    rows = placed(chunks).withColumn("first", upward(F.col("start")))
    most = F.call_function("div", F.col("total") * rate, old)
    rows = rows.withColumn("_end", F.least(upward(F.col("start") + F.size("data")), most)).where("_end > first").withColumn("_x", F.concat("data", F.array("after")))

    def sample(j):
        at = (F.call_function("div", j * old, F.lit(rate)) - F.col("start")).cast("int")
        low, high = F.get("_x", at).cast("double"), F.get("_x", at + 1).cast("double")
        return low + (high - low) * (F.pmod(j * old, F.lit(rate)) / F.lit(float(rate)))

    # a projection of its own: within one that also renames the rate, a lambda would read the new one
    new = rows.withColumn("_new", F.transform(F.sequence("first", F.col("_end") - 1), sample))
    return new.select("asset_id", "index", F.lit(rate).alias("sample_rate"), "first", F.col("_new").alias("data"))
