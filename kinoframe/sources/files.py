"""File sources: containers and scripts that Spark reads as whole files from any file system and splits into relations.

Files come through Spark's ``binaryFile`` and ``text`` readers, so any store that Spark reads will do. A file is a task's
unit of work and must fit in an executor; large recordings are to be cut into segments, as live packagers do.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.operators import bitstream, subtitles


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(asset_id, data): a row a file; the asset is its path."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("asset_id"), F.col("content").alias("data"))


def flv_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of FLV files: asset_id, seq, stream_index (8 audio, 9 video, 18 data), pts_us, size, is_key, is_header, data."""
    tags = bitstream.flv_tags(whole_files(spark, path))
    body, video = F.col("body"), F.col("tag_type") == 9
    return tags.select(
        "asset_id",
        F.col("tag_no").cast("long").alias("seq"),
        F.col("tag_type").alias("stream_index"),
        (F.col("timestamp_ms") * 1000).alias("pts_us"),
        F.octet_length(body).cast("long").alias("size"),
        (video & bitstream.is_video_key(body)).alias("is_key"),
        F.when(video, bitstream.is_video_header(body)).otherwise(bitstream.is_audio_header(body)).alias("is_header"),
        body.alias("data"),
    )


WAV = "sample_rate int, channels int, bits int, chunks array<struct<index: long, pcm: binary>>, problem string"


def wav_parts(data: bytes, frames: int) -> tuple:
    """Format and PCM of a RIFF file in pieces of ``frames`` sample frames; what is cut off at the end is left."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None, None, None, [], "no RIFF header"
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and kind:
            _, channels, rate, _, align, bits = kind
            body = data[at + 8 : at + 8 + size]
            body = body[: len(body) // align * align]
            step = frames * align
            return rate, channels, bits, [{"index": i // step, "pcm": body[i : i + step]} for i in range(0, len(body), step)], None
        at += 8 + size + size % 2
    return None, None, None, [], "no data chunk"


def wav_chunks(spark: SparkSession, path: str, frames: int = 4096) -> DataFrame:
    """PCM of WAV files in chunks: asset_id, sample_rate, channels, bits, index, pts_us, pcm."""
    found = bitstream.by_rows(whole_files(spark, path, "*.wav"), "data", lambda data: wav_parts(data, frames), WAV)
    rows = found.where("problem is null").select("asset_id", "sample_rate", "channels", "bits", F.inline("chunks"))
    return rows.withColumn("pts_us", F.call_function("div", F.col("index") * frames * 1_000_000, F.col("sample_rate").cast("long")))


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, script): a row a text file, a byte order mark taken off."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("script"))
    return rows.withColumn("script", F.regexp_replace("script", "^﻿", ""))


def ass_events(spark: SparkSession, path: str) -> DataFrame:
    return subtitles.events(scripts(spark, path))


def srt_cues(spark: SparkSession, path: str) -> DataFrame:
    return subtitles.srt_cues(scripts(spark, path))


def write_packets(packets: DataFrame, path: str, segment_us: int | None = None) -> None:
    """Packets as Parquet, a folder a stream (and segment), each file in packet order."""
    keys = ["stream_index"]
    if segment_us:
        packets, keys = packets.withColumn("segment", F.call_function("div", F.col("pts_us"), F.lit(segment_us))), [*keys, "segment"]
    packets.repartition(*keys, F.call_function("div", F.col("seq"), F.lit(1_000_000))).sortWithinPartitions(*keys, "seq").write.partitionBy(*keys).parquet(path)


def write_playlists(playlists: DataFrame, path: str) -> None:
    """Playlists (asset_id, playlist) as text, a folder an asset."""
    playlists.select("asset_id", F.regexp_replace("playlist", "\n$", "").alias("value")).write.partitionBy("asset_id").text(path)
