"""FLV and WAV files as Spark data sources that read one file in many tasks, and write with a commit.

A file is cut into ranges of bytes. A range of an FLV file has the tags that begin in it; its reader looks for the first one
by itself: a header, the size of the tag repeated behind it, and so on from tag to tag until no tag that could hold all this
as its body reaches as far (a body has less than 16 MB), or the file ends. A single tag that the end cuts off is left. Sample frames of a WAV file have one size, so its
ranges follow from its header. Column pruning: what is not in the schema that a reader is given (``.schema(...)``) is not read,
which for ``data`` is most of a file.

Files are opened through Arrow's file systems (local, HDFS, S3, GCS), by the URI in ``path``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
#: A tag's header, the size behind it, and the most that header, body and size take.
HEAD, TAIL, MOST = 11, 4, (1 << 24) + 15
FLV_START = b"FLV\x01\x05\x00\x00\x00\x09\x00\x00\x00\x00"
TAG_KINDS = (8, 9, 18)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int

    def __hash__(self) -> int:
        return hash((self.path, self.begin))


def at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def hidden(path: str, home: str) -> bool:
    """Whether a file, or a folder below ``home`` that it is in, is none of the data: such as what a failed task left."""
    return any(p.startswith(("_", ".")) for p in path.removeprefix(home.lstrip("/") if not path.startswith("/") else home).split("/"))


class Files(DataSourceReader):
    """Ranges of all files with an ending under ``path``."""

    ending = ""

    def __init__(self, schema: StructType, options: dict):
        self.options, self.arrow = options, to_arrow_schema(schema)
        self.names = set(schema.names)

    def partitions(self) -> list[Range]:
        files, where = at(self.options["path"])
        one = files.get_file_info(where)
        found = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where, recursive=True))
        step = int(self.options.get("rangebytes", RANGE_BYTES))
        prefix = "" if files.type_name == "local" else self.options["path"].split("://")[0] + "://"
        return [Range(prefix + f.path, a, min(a + step, f.size), f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.ending) and not hidden(f.path, where) for a in range(0, f.size, step)]

    def rows(self, part: Range, file) -> Iterator[dict]:
        raise NotImplementedError

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file, no range
            return
        files, where = at(part.path)
        held, size = [], 0
        with files.open_input_file(where) as file:
            for row in self.rows(part, file):
                held.append(row)
                size += len(row.get("data") or row.get("pcm") or b"") + 64
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, self.arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, self.arrow)


def tag_size(file, pos: int, size: int) -> int | None:
    """Bytes of the tag at ``pos``, with its header and the size behind it; None if there is none, or it is cut off."""
    if pos + HEAD + TAIL > size:
        return None
    head = file.read_at(HEAD, pos)
    n = int.from_bytes(head[1:4])
    if head[0] & 31 not in TAG_KINDS or head[8:] != bytes(3) or pos + HEAD + n + TAIL > size:
        return None
    return HEAD + n + TAIL if int.from_bytes(file.read_at(TAIL, pos + HEAD + n)) == HEAD + n else None


def is_tag(file, pos: int, size: int) -> bool:
    """Whether tags follow one another from here past the end of any body that could hold them, or to the end of the file. Where
    that end cuts one off, which may be inside a body, tags have to lead back from here in the same way."""
    p = pos
    while p - pos <= MOST and p < size:
        n = tag_size(file, p, size)
        if n is None:
            return p > pos and cut_off(file, p, size) and led_to(file, pos, size)
        p += n
    return True


def led_to(file, pos: int, size: int) -> bool:
    p = pos
    while pos - p <= MOST and p > len(FLV_START):
        back = p - TAIL - int.from_bytes(file.read_at(TAIL, p - TAIL))
        if not len(FLV_START) <= back < p - TAIL or tag_size(file, back, size) != p - back:
            return False
        p = back
    return p >= len(FLV_START)


def cut_off(file, pos: int, size: int) -> bool:
    """Whether what begins here is a tag that the end of the file cuts off."""
    head = file.read_at(min(HEAD, size - pos), pos)
    return head[0] & 31 in TAG_KINDS and (len(head) < HEAD or head[8:] == bytes(3) and pos + HEAD + int.from_bytes(head[1:4]) + TAIL > size)


class FlvReader(Files):
    ending = ".flv"

    def first(self, part: Range, file) -> int:
        """Where the first tag of a range begins, or its end."""
        pos = max(part.begin, len(FLV_START))
        if part.begin <= len(FLV_START):
            return pos
        while pos < part.end:
            piece = file.read_at(min(1 << 16, part.end - pos) + HEAD, pos)
            for i in range(min(1 << 16, part.end - pos)):
                if piece[i] & 31 in TAG_KINDS and piece[i + 8 : i + HEAD] == bytes(3) and is_tag(file, pos + i, part.size):
                    return pos + i
            pos += 1 << 16
        return part.end

    def rows(self, part: Range, file) -> Iterator[dict]:
        if file.read_at(3, 0) != b"FLV":
            return
        pos = self.first(part, file)
        while pos < part.end:
            n = tag_size(file, pos, part.size)
            if n is None:
                return
            head = file.read_at(HEAD, pos)
            row = {"path": part.path, "pos": pos, "tag_type": head[0] & 31, "timestamp_ms": int.from_bytes(head[4:7]) | head[7] << 24, "size": n - HEAD - TAIL}
            if "data" in self.names:
                row["data"] = file.read_at(n - HEAD - TAIL, pos + HEAD)
            yield {k: v for k, v in row.items() if k in self.names}
            pos += n


class WavReader(Files):
    ending = ".wav"

    def rows(self, part: Range, file) -> Iterator[dict]:
        """Pieces of ``frames`` sample frames that begin in a range; what is cut off of the last frame is left."""
        if file.read_at(4, 0) != b"RIFF" or file.read_at(4, 8) != b"WAVE":
            return
        pos, kind = 12, None
        while pos + 8 <= part.size:
            name, n = struct.unpack("<4sI", file.read_at(8, pos))
            if name == b"fmt " and n >= 16:
                kind = struct.unpack("<HHIIHH", file.read_at(16, pos + 8))
            elif name == b"data" and kind:
                break
            pos += 8 + n + n % 2
        else:
            return
        _, channels, rate, _, align, bits = kind
        begin, whole = pos + 8, min(n, part.size - pos - 8) // align
        step = int(self.options.get("frames", 4096))
        first = max(0, -(-(part.begin - begin) // (align * step))) * step
        for index in range(first, whole, step):
            if begin + index * align >= part.end:
                return
            row = {"path": part.path, "index": index, "sample_rate": rate, "channels": channels, "bits": bits, "frames": min(step, whole - index)}
            if "pcm" in self.names:
                row["pcm"] = file.read_at(row["frames"] * align, begin + index * align)
            yield {k: v for k, v in row.items() if k in self.names}


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    name: str


class Sink(DataSourceWriter):
    """A file a task, written beside its place and moved there when all tasks are done. What failed is never read; a task that still
    ran when its job failed may leave a hidden file."""

    ending = ""

    def __init__(self, schema: StructType, options: dict):
        self.options, self.run = options, uuid4().hex

    def bytes_of(self, rows: Iterator) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, where = at(self.options["path"])
        name = f"part-{task.partitionId():05d}-{self.run}{self.ending}"
        temporary = f"{where.rstrip('/')}/_temporary-{self.run}/{task.taskAttemptId()}-{name}"
        files.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(temporary) as file:
            for piece in self.bytes_of(rows):
                file.write(piece)
        return Written(temporary, name)

    def commit(self, messages: list) -> None:
        files, where = at(self.options["path"])
        for m in filter(None, messages):
            files.move(m.temporary, f"{where.rstrip('/')}/{m.name}")
        self.abort([])

    def abort(self, messages: list) -> None:
        files, where = at(self.options["path"])
        home = f"{where.rstrip('/')}/_temporary-{self.run}"
        if files.get_file_info(home).type == fs.FileType.Directory:
            files.delete_dir(home)


class FlvWriter(Sink):
    """Rows (tag_type, timestamp_ms, data) in the order in which a task gets them."""

    ending = ".flv"

    def bytes_of(self, rows: Iterator) -> Iterator[bytes]:
        yield FLV_START
        for r in rows:
            body = bytes(r["data"] or b"")
            if len(body) >= 1 << 24:
                raise ValueError("a tag's body has less than 16 MB")
            t = r["timestamp_ms"]
            yield bytes([r["tag_type"]]) + len(body).to_bytes(3) + (t & 0xFFFFFF).to_bytes(3) + bytes([t >> 24 & 255]) + bytes(3) + body + (HEAD + len(body)).to_bytes(4)


class WavWriter(Sink):
    """Rows (pcm) of 16-bit sound in the order in which a task gets them; the size of what follows is not known at the
    beginning and is given as the most there can be."""

    ending = ".wav"

    def bytes_of(self, rows: Iterator) -> Iterator[bytes]:
        rate, channels = int(self.options.get("samplerate", 16_000)), int(self.options.get("channels", 1))
        yield struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", 0xFFFFFFFF)
        for r in rows:
            yield bytes(r["pcm"] or b"")


class FlvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flv"

    def schema(self) -> str:
        return "path string, pos long, tag_type int, timestamp_ms long, size long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FlvReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FlvWriter(schema, self.options)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, index long, sample_rate int, channels int, bits int, frames int, pcm binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WavWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes ``flv`` and ``wav`` known as formats."""
    for source in (FlvSource, WavSource):
        spark.dataSource.register(source)
