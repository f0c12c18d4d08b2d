"""File sources and sinks round trip through a folder."""

import wave

from pyspark.sql import functions as F

from kinoframe.operators import bitstream, recipes
from kinoframe.plans import codec_queries
from kinoframe.plans.codec_queries import whole
from kinoframe.sources import files


def test_flv_round_trip(spark, tmp_path):
    rows = [(0, 9, 0, b"\x17\x00\x01"), (1, 8, 5, b"\xaf\x01\x02"), (2, 9, 0x1234567, b"\x17\x01\x00\x00"), (3, 9, 40, b"\x27\x01")]
    tags = spark.createDataFrame(rows, "seq long, kind long, ms long, body binary").withColumn("tag", bitstream.flv_tag(F.col("kind"), F.col("ms"), F.col("body")))
    data = bytes(bitstream.flv_stream(tags.withColumn("k", F.lit(1)), "k").first().data)
    (tmp_path / "a.flv").write_bytes(data)
    (tmp_path / "b.flv").write_bytes(data[:-3])
    got = [(r.asset_id[-5:], r.seq, r.stream_index, r.pts_us, r.size, r.is_key, r.is_header) for r in files.flv_packets(spark, str(tmp_path)).orderBy("asset_id", "seq").collect()]
    want = [(0, 9, 0, 3, False, True), (1, 8, 5000, 3, False, False), (2, 9, 0x1234567 * 1000, 4, True, False), (3, 9, 40_000, 2, False, False)]
    assert got == [("a.flv", *w) for w in want] + [("b.flv", *w) for w in want[:3]]


def test_flv_stamps_past_32_bits(spark):
    stamps = [0, (1 << 32) - 1, 1 << 32, (1 << 32) + 40, 5, 3_999_960_000, 40_000 * 5_999_999, -40, 1 << 60]
    rows = [(i, 8 + i % 2, t, b"\xaf\x01\x21") for i, t in enumerate(stamps)]
    tags = spark.createDataFrame(rows, "seq long, kind long, ms long, body binary").withColumn("tag", bitstream.flv_tag(F.col("kind"), F.col("ms"), F.col("body")))
    data = bytes(bitstream.flv_stream(tags.withColumn("k", F.lit(1)), "k").first().data)
    for cut in (0, 1, 20, 60):
        files = spark.createDataFrame([(1, data[: len(data) - cut])], "k long, data binary")
        got = [(r.tag_no, r.tag_type, r.timestamp_ms, bytes(r.body)) for r in bitstream.flv_tags(files).orderBy("tag_no").collect()]
        assert got == (rows[:-1] if cut else rows)
    own = bitstream.flv_tag(F.lit(18), F.lit(7), F.lit(bitstream.STAMP + b"0" * 15 + b"x"))
    (row,) = bitstream.flv_tags(spark.range(1).select(F.concat(F.lit(bitstream.FLV_HEADER), own).alias("data"))).collect()
    assert (row.tag_type, row.timestamp_ms) == (18, 7)


def test_wav_chunks(spark, tmp_path):
    pcm = bytes(range(256)) * 40
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(pcm)
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rows = files.wav_chunks(spark, str(tmp_path), frames=1000).orderBy("index").collect()
    assert b"".join(bytes(r.pcm) for r in rows) == pcm
    assert [(r["index"], r.pts_us, r.channels, r.bits) for r in rows] == [(0, 0, 2, 16), (1, 125_000, 2, 16), (2, 250_000, 2, 16)]


def test_scripts(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n", encoding="utf-8")
    (row,) = files.srt_cues(spark, str(tmp_path / "a.srt")).collect()
    assert (row.start_ms, row.duration_ms, row.text.strip()) == (1000, 1500, "hello\nthere")


def test_sinks(spark, tmp_path):
    packets = spark.createDataFrame([(s, i, i * 1_000_000, 5) for s in (1, 2) for i in range(6)], "stream_index long, seq long, pts_us long, size long")
    files.write_packets(packets, str(tmp_path / "p"), segment_us=2_000_000)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 12 and back.select("stream_index", "segment").distinct().count() == 6
    streams = spark.createDataFrame([(1,), (2,)], "stream_index long")
    files.write_playlists(recipes.ladder_playlists(streams, [("low", 640, 360, 800_000)]), str(tmp_path / "m"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).where("asset_id = 1").collect()]
    assert lines == ["#EXTM3U", "#EXT-X-VERSION:3", "#EXT-X-STREAM-INF:BANDWIDTH=1020800,RESOLUTION=640x360", "low/index.m3u8"]


def test_codes_with_stated_results():
    for given, want in [
    # 1, 010, 011, 00100, then closing
    (whole("1", "010", "011", "00100", "00111", "1"), "0 1 2 3 6"), (whole("0" * 31 + "1" * 32, "1", "1", "1", "1"), "4294967294 0 0 0 0"), (whole("0" * 32 + "1" * 33, "1", "1", "1", "1"), None),
    (whole("0001000", "0001111", "1", "1", "1"), "7 14 0 0 0"),
]:
        assert codec_queries.codes(bytes.fromhex(given)) == want
