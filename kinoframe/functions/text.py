"""Text grammars as column expressions: bit rates, seconds, playlists, subtitle values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions.rational import MICROS, ceil_div

# File extensions of fonts, with MIME type and codec.
FONTS = {"ttf": ("application/x-truetype-font", "ttf"), "otf": ("application/vnd.ms-opentype", "otf")}


def bitrate_bps(text: Column) -> Column:
    """``2500k``, ``2.5M``, ``1G`` or a plain number as bits a second, rounded; null for what is not above 0."""
    shape = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([kKmMgG]?)\s*$"
    n = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, shape, 2))
    scaled = n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(text.rlike(shape) & (n > 0) & (n < float("inf")), F.floor(scaled + 0.5).cast("long"))


def seconds_us(text: Column) -> Column:
    """Strict decimal seconds (digits, a point, digits) as microseconds, rounded; null for anything else."""
    us = F.floor(text.try_cast("double") * MICROS + 0.5)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$") & (text.try_cast("double") < 9.2e12), us.cast("long"))


def gop_frames(fps_num: Column, fps_den: Column, segment_us: int) -> Column:
    """Frames a segment, rounded up, 1 at least."""
    return F.greatest(F.lit(1), ceil_div(fps_num.cast("long") * segment_us, fps_den.cast("long") * MICROS))


def bandwidth(video_bps: Column, audio_bps: Column) -> Column:
    """Peak bandwidth of a rendition: a tenth over both rates, cut down."""
    return F.call_function("div", (video_bps + audio_bps) * 11, F.lit(10))


def font_of(path: Column, which: int, other: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in FONTS.items() for x in (k, v[which])])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))), F.lit(other))


def mime_type(path: Column) -> Column:
    """MIME type of an attachment by its extension: fonts have one, all else is a stream of bytes."""
    return font_of(path, 0, "application/octet-stream")


def codec_id(path: Column) -> Column:
    """Codec of an attachment by its extension."""
    return font_of(path, 1, "none")


def master_playlist(variants: DataFrame, version: int = 3) -> DataFrame:
    """A playlist an asset: a header, then two lines a variant in order of bandwidth. ``variants``: asset_id, bandwidth, width, height, uri."""
    line = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("bandwidth"), F.lit(",RESOLUTION="), F.col("width"), F.lit("x"), F.col("height"), F.lit("\n"), F.col("uri"), F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("bandwidth", "uri", line.alias("line")))), lambda x: x.line)
    return variants.groupBy("asset_id").agg(F.concat(F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n"), F.array_join(lines, "")).alias("playlist"))


def nearest(words: DataFrame, options: DataFrame, most: int = 2) -> DataFrame:
    """Each word's nearest option by edit distance, if within ``most``; the first option wins ties.

    ``words``: (word); ``options``: (place, option). An option within ``most`` edits keeps one of ``most`` + 1 pieces as it
    is, moved by ``most`` at most, so pairs meet by equal pieces of equal places: no word is compared with every option.
    """
    pieces = F.explode(F.sequence(F.lit(0), F.lit(most)))
    cut = lambda i: F.floor(i * F.col("_size") / (most + 1)).cast("int")
    bounds = lambda rows: rows.withColumn("_piece", pieces).withColumn("_a", cut(F.col("_piece"))).withColumn("_n", cut(F.col("_piece") + 1) - F.col("_a"))
    kept = bounds(options.select("place", "option", F.length("option").alias("_size"))).withColumn("_text", F.substr(F.col("option"), F.col("_a") + 1, F.col("_n")))
    size = F.length("word")
    probes = bounds(words.select("word", F.explode(F.sequence(F.greatest(size - most, F.lit(0)), size + most)).alias("_size")))
    probes = probes.withColumn("_at", F.explode(F.sequence(F.greatest(F.col("_a") - most, F.lit(0)), F.col("_a") + most))).where(F.col("_at") + F.col("_n") <= size)
    key = ["_size", "_piece", "_text"]
    probes = probes.withColumn("_text", F.substr(F.col("word"), F.col("_at") + 1, F.col("_n"))).select("word", *key).distinct()
    pairs = probes.join(kept.select("place", "option", *key), key).select("word", "place", "option").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "option")).where(F.col("distance") <= most)
    return near.groupBy("word").agg(F.min(F.struct("distance", "place", "option")).alias("n")).select("word", "n.option", "n.distance")


def timecode_ms(text: Column) -> Column:
    """``h:m:s.c`` as milliseconds; the last field counts hundredths whatever its digits. Null where a field is missing."""
    shape = r"^\s*([+-]?[0-9]+):\s*([+-]?[0-9]+):\s*([+-]?[0-9]+)\.\s*([+-]?[0-9]+)"
    part = [F.regexp_extract(text, shape, i).try_cast("long") for i in (1, 2, 3, 4)]
    return F.when(text.rlike(shape), ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3] * 10)


def srt_ms(text: Column) -> Column:
    """``hh:mm:ss,mmm`` as milliseconds."""
    shape = r"^([0-9]+):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})$"
    part = [F.regexp_extract(text, shape, i).try_cast("long") for i in (1, 2, 3, 4)]
    return F.when(text.rlike(shape), ((part[0] * 60 + part[1]) * 60 + part[2]) * 1000 + part[3])


def fade(now: Column, a: tuple[int, int, int], t: tuple[int, int, int, int]) -> Column:
    """Transparency of a seven-part fade at ``now``: a1 until t1, to a2 by t2, until t3, to a3 by t4; fractions are cut."""
    now = now.cast("double")

    def ramp(x, y, t0, t1):
        k = (now - t0) / max(t1 - t0, 1)
        return (F.lit(float(x)) * (1 - k) + F.lit(float(y)) * k).cast("int")

    return F.when(now < t[0], a[0]).when(now < t[1], ramp(a[0], a[1], t[0], t[1])).when(now < t[2], a[1]).when(now < t[3], ramp(a[1], a[2], t[2], t[3])).otherwise(a[2])


def moved(now: Column, duration: Column, start: tuple[float, float], stop: tuple[float, float], t1: int = 0, t2: int = 0) -> tuple[Column, Column]:
    """Anchor of a linear move at ``now``; without times it lasts the whole event."""
    whole = t1 <= 0 and t2 <= 0
    begin, end = (F.lit(0), duration) if whole else (F.lit(t1), F.lit(t2))
    k = F.when(now <= begin, 0.0).when(now >= end, 1.0).otherwise((now - begin).cast("double") / F.greatest(end - begin, F.lit(1)))
    return tuple(F.lit(float(x)) + k * F.lit(float(y) - float(x)) for x, y in zip(start, stop))


def karaoke(syllables: DataFrame, at_ms: int) -> DataFrame:
    """Whether each syllable of a line has begun at a time: durations add up along the line."""
    w = Window.partitionBy("script_id", "read_order").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return syllables.withColumn("begin_ms", F.coalesce(F.sum("ms").over(w), F.lit(0))).withColumn("sung", F.col("begin_ms") <= at_ms)
