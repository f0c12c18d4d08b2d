"""Byte formats inside packets: NAL units, FLV tags, AAC configuration."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAL_SCHEMA = "nals array<struct<nal_no: int, nal_type: int, size: int, data: binary>>, problem string"
START = re.compile(rb"\x00\x00\x01")


def annexb_units(data: bytes) -> tuple[list[bytes], str | None]:
    """NAL units of an Annex-B access unit, or what is wrong with it.

    A unit ends before the next start code; zeros before that code and at the end of the data are padding.
    """
    marks = [m.start() for m in START.finditer(data)]
    if len(data) < 4:
        return [], "too short"
    if not marks or data[: marks[0]].strip(b"\x00"):
        return [], "no start code in front"
    units = [data[a + 3 : b].rstrip(b"\x00") for a, b in zip(marks, [*marks[1:], len(data)])]
    if any(not u for u in units):
        return [], "empty unit"
    return units, None


def prefixed_units(data: bytes) -> tuple[list[bytes], str | None]:
    """NAL units behind 4-byte lengths, or what is wrong with the packet."""
    units, at = [], 0
    while at < len(data):
        if len(data) - at < 4:
            return [], "length cut off"
        (n,) = struct.unpack_from(">I", data, at)
        if n == 0:
            return [], "empty unit"
        if at + 4 + n > len(data):
            return [], "unit cut off"
        units.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return units, None if units else "no units"


def by_rows(rows: DataFrame, binary: str, work: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """``rows`` with columns that ``work`` makes of a binary column, by Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    extra = _parse_datatype_string(schema)
    keep = [f for f in rows.schema if f.name != binary]
    full = StructType([*keep, *extra])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(x) if x is not None else (None,) * len(extra) for x in batch.column(batch.schema.get_field_index(binary)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            new = [pa.array([m[i] for m in made], arrow.field(len(kept) + i).type) for i in range(len(extra))]
            yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return rows.mapInArrow(run, full)


def unpacked(split: Callable[[bytes], tuple]) -> Callable[[bytes], tuple]:
    def work(data: bytes):
        units, problem = split(data)
        return [{"nal_no": i, "nal_type": u[0] & 31, "size": len(u), "data": u} for i, u in enumerate(units)], problem

    return work


def nal_units(packets: DataFrame, prefixed: bool = False, binary: str = "data") -> DataFrame:
    """Packets with their NAL units as an array, and what is wrong with those that have none."""
    return by_rows(packets, binary, unpacked(prefixed_units if prefixed else annexb_units), NAL_SCHEMA)


def scan(units: DataFrame) -> DataFrame:
    """Units with their count, whether there is an IDR slice (5), and whether there is a parameter set (7 or 8)."""
    has = lambda *k: F.exists("nals", lambda n: n.nal_type.isin(*k))
    return units.withColumn("nal_count", F.size("nals")).withColumn("has_idr", has(5)).withColumn("has_parameter_set", has(7, 8))


def length_prefixed(units: DataFrame) -> DataFrame:
    """Units joined again, each behind its length: natively, from the array."""
    one = lambda n: F.concat(F.lpad(F.hex(n["size"]), 8, "0"), F.hex(n.data))
    return units.withColumn("sample", joined(F.transform("nals", one)))


def joined(parts: Column) -> Column:
    """Pieces in hexadecimal as one binary: each byte is copied once, however many pieces there are."""
    return F.unhex(F.array_join(parts, ""))


def byte_at(data: Column, i: int) -> Column:
    """Byte ``i`` (from 0) of a binary; null past its end."""
    return F.when(F.octet_length(data) > i, F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int"))


def starts_with_bytes(data: Column, *values: int) -> Column:
    return F.coalesce(F.substring(data, 1, len(values)) == F.lit(bytes(values)), F.lit(False))


def is_video_header(body: Column) -> Column:
    """AVC configuration: key frame, AVC, packet type 0."""
    return starts_with_bytes(body, 0x17, 0)


def is_video_key(body: Column) -> Column:
    """AVC key picture: key frame, AVC, packet type 1."""
    return starts_with_bytes(body, 0x17, 1)


def is_audio_header(body: Column) -> Column:
    """AAC configuration: AAC, packet type 0."""
    return starts_with_bytes(body, 0xAF, 0)


def big_endian(n: Column, size: int) -> Column:
    """A whole number as ``size`` bytes, highest first."""
    return F.unhex(F.lpad(F.hex(n), 2 * size, "0"))


#: The body of a script tag that gives the stamp of the tag behind it: a name, and a text of 16 hexadecimal digits.
STAMP = b"\x02\x00\x07onStamp\x02\x00\x10"


def flv_tag(kind: Column, timestamp_ms: Column, body: Column) -> Column:
    """A tag's bytes: header of 11 (the stamp's top byte last), body, and the size of both. A stamp that its 32 bits do not hold
    is whole in a script tag before it."""
    low, high = timestamp_ms.bitwiseAND(F.lit(0xFFFFFF)), F.shiftright(timestamp_ms, 24).bitwiseAND(F.lit(255))

    def tag(kind: Column, body: Column) -> Column:
        n = F.octet_length(body).cast("long")
        return F.concat(big_endian(kind, 1), big_endian(n, 3), big_endian(low, 3), big_endian(high, 1), F.lit(bytes(3)), body, big_endian(n + 11, 4))

    whole = tag(F.lit(18), F.concat(F.lit(STAMP), F.lpad(F.hex(timestamp_ms), 16, "0").cast("binary")))
    return F.when(timestamp_ms.between(0, 0xFFFFFFFF), tag(kind, body)).otherwise(F.concat(whole, tag(kind, body)))


def whole_stamp(kind: int, stamp: int, body: bytes) -> int | None:
    """The stamp that a script tag gives the tag behind it; None of any other tag."""
    digits = body[len(STAMP) :]
    if kind != 18 or not body.startswith(STAMP) or not re.fullmatch(rb"[0-9A-F]{16}", digits):
        return None
    told = int.from_bytes(bytes.fromhex(digits.decode()), signed=True)
    return told if told & 0xFFFFFFFF == stamp else None


FLV_HEADER = b"FLV\x01\x05\x00\x00\x00\x09\x00\x00\x00\x00"


def flv_stream(tags: DataFrame, key: str) -> DataFrame:
    """One FLV file a key from (key, seq, tag) rows; a key's tags must fit in a task."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda x: F.hex(x.tag))
    return tags.groupBy(key).agg(joined(F.concat(F.array(F.lit(FLV_HEADER.hex())), parts)).alias("data"))


def flv_tags(files: DataFrame, binary: str = "data") -> DataFrame:
    """A row a complete tag: tag_no, tag_type, timestamp_ms, body. What is cut off at the end is left; a bad header gives nothing.
    Script tags that hold the stamp of the tag behind them (``flv_tag``) are no rows."""

    def work(data: bytes):
        out, at, told = [], 13, None
        if data[:3] != b"FLV" or len(data) < 13:
            return ([],)
        while at + 11 <= len(data):
            kind, n = data[at], int.from_bytes(data[at + 1 : at + 4])
            stamp = int.from_bytes(data[at + 4 : at + 7]) | data[at + 7] << 24
            if at + 11 + n + 4 > len(data):
                break
            body = data[at + 11 : at + 11 + n]
            at += 15 + n
            before, told = told, whole_stamp(kind, stamp, body)
            if told is None:
                out.append({"tag_no": len(out), "tag_type": kind, "timestamp_ms": stamp if before is None else before, "body": body})
        return (out,)

    found = by_rows(files, binary, work, "tags array<struct<tag_no: int, tag_type: int, timestamp_ms: long, body: binary>>")
    return found.select(*[c for c in found.columns if c != "tags"], F.inline("tags"))


# Sampling rates of the AAC configuration's index.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def aac_config(data: Column) -> Column:
    """Object type, rate and channels of a two-byte AAC configuration, and its codec string."""
    v = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    kind, rate, channels = F.shiftright(v, 11), F.shiftright(v, 7).bitwiseAND(F.lit(15)), F.shiftright(v, 3).bitwiseAND(F.lit(15))
    hz = F.try_element_at(F.array(*[F.lit(r) for r in AAC_RATES]), rate + 1)
    return F.struct(kind.alias("object_type"), hz.alias("sample_rate"), channels.alias("channels"), F.concat(F.lit("mp4a.40."), kind).alias("codec"))
