"""Media sources: ranges against whole files, at every place where a file can be cut; the writer's commit."""

import random
import struct

import pytest

from kinoframe.sources import media


def tag(kind, stamp, body):
    return bytes([kind]) + len(body).to_bytes(3) + (stamp & 0xFFFFFF).to_bytes(3) + bytes([stamp >> 24]) + bytes(3) + body + (11 + len(body)).to_bytes(4)


def flv_file():
    """Bodies that hold tags, whole streams and headers without an end."""
    pick = random.Random(3)
    inner = media.FLV_START + b"".join(tag(9, i, bytes(pick.randrange(256) for _ in range(9))) for i in range(4))
    bodies = [b"", b"abc", inner, tag(8, 1, b"x" * 20), tag(9, 5, b"")[:-1] + b"\x00", bytes(40), inner[13:], b"\x09\x00\x00\x05" + bytes(7)]
    tags = [((8, 9, 18)[i % 3], i << 20, bodies[pick.randrange(len(bodies))]) for i in range(30)]
    return media.FLV_START + b"".join(tag(*t) for t in tags), tags


def ranged(kind, reader, path, step, names=None):
    options = {"path": str(path), "rangebytes": str(step), "frames": "3"}
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(kind(options).schema())
    if names:
        schema = type(schema)([f for f in schema if f.name in names])
    found = reader(schema, options)
    parts = found.partitions()
    return len(parts), [r for p in parts for b in found.read(p) for r in b.to_pylist()]


def test_flv_ranges_equal_the_file_at_every_step(spark, tmp_path):
    data, tags = flv_file()
    for cut in (0, 3, 17):
        path = tmp_path / f"cut{cut}.flv"
        path.write_bytes(data[: len(data) - cut] if cut else data)
        want = tags if not cut else tags[: sum(1 for i in range(30) if 13 + sum(15 + len(t[2]) for t in tags[: i + 1]) <= len(data) - cut)]
        for step in [*range(14, 160), 700, 1 << 20]:
            n, rows = ranged(media.FlvSource, media.FlvReader, path, step)
            assert [(r["tag_type"], r["timestamp_ms"], r["data"]) for r in rows] == want and (n > 1) == (step < len(data) - cut)
    assert all("data" not in r for r in ranged(media.FlvSource, media.FlvReader, path, 99, ["pos", "size"])[1])
    (tmp_path / "none.flv").write_bytes(b"no such file at all")
    assert ranged(media.FlvSource, media.FlvReader, tmp_path / "none.flv", 5)[1] == []


@pytest.mark.parametrize("extra", [b"", b"LIST\x03\x00\x00\x00abc\x00"])
def test_wav_ranges_equal_the_file_at_every_step(spark, tmp_path, extra):
    pcm = bytes(range(1, 200))
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8_000, 32_000, 4, 16) + extra + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "a.wav").write_bytes(data)
    for step in range(1, 120, 7):
        _, rows = ranged(media.WavSource, media.WavReader, tmp_path, step)
        assert b"".join(r["pcm"] for r in rows) == pcm[: len(pcm) // 4 * 4] and [r["index"] for r in rows] == list(range(0, 49, 3))


def test_written_files_are_read_in_several_tasks(spark, tmp_path):
    media.register(spark)
    rows = [(8 if i % 2 else 9, i * 40, bytes([i % 256]) * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "tag_type int, timestamp_ms long, data binary").repartition(3)
    df.write.format("flv").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("flv").option("rangeBytes", 1_000).load(str(tmp_path / "out"))
    assert sorted((r.tag_type, r.timestamp_ms, bytes(r.data)) for r in back.collect()) == sorted(rows) and back.rdd.getNumPartitions() > 6
    slim = spark.read.format("flv").schema("timestamp_ms long").load(str(tmp_path / "out"))
    assert slim.columns == ["timestamp_ms"] and slim.count() == 400
    assert not [p for p in (tmp_path / "out").iterdir() if "temporary" in p.name]

    def broken(batches):
        for b in batches:
            yield b
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        df.mapInArrow(broken, df.schema).write.format("flv").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.flv")) and spark.read.format("flv").load(str(tmp_path / "bad")).count() == 0
