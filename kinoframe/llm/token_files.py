"""Token-id files: documents compressed one by one against a shared zstandard dictionary.

Format. ``<path>/dictionary`` holds one row: the dictionary's bytes and its SHA-256. ``<path>/blocks`` holds a row a
block of consecutive documents in ascending id order: where the block stands (``part``, ``block``), the dictionary's
hash, an index (for each document: id, byte offset and length of its frame, number of ids) and ``payload``, the frames
end to end. A frame is a document's ids as little-endian unsigned integers of ``width`` bytes. One document is read by
the block whose id range holds it (Parquet statistics prune the rest) and one slice of the payload.

The dictionary is trained on the id arrays of a bounded sample (``sample_docs`` documents in expectation, their first
``sample_ids`` ids); everything else covers all rows. The text moves once, into ranges of ids; files are committed by
Spark's writer, so lost executors and repeated tasks leave no half files.

Defined results: a null or empty text is the end id alone; null document ids come first; repeated ids are all kept,
in the order of their texts; a very long text is one frame of its block, however long; an empty table writes a dictionary and no blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinoframe.llm.base import map_texts, only, scratch, slices, starts_of
from kinoframe.llm.tokens import dropped

BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096

BLOCK_SCHEMA = (
    "part int, block int, first_doc long, last_doc long, n_docs int, n_tokens long, width int, dict_sha256 string, "
    "index array<struct<doc_id: long, offset: int, length: int, n_ids: int>>, payload binary"
)


def train(docs: DataFrame, path: str, end_id: int, width: int, sample_docs: int = 1500, sample_ids: int = 1500, dict_bytes: int = 32 << 10) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized id arrays."""
    import zstandard

    every, end = max(1, docs.count() // sample_docs), end_id.to_bytes(width, "little")
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def make():
        units = dropped(path, width)
        return lambda ids, texts: {"ids": [(x + end)[: sample_ids * width] for x in units.encode([t or "" for t in texts])]}

    samples = [bytes(r.ids) for r in map_texts(part, make, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: what there is serves as content
        return b"".join(samples)[-dict_bytes:] or bytes(16)


def write(docs: DataFrame, out: str, path: str, end_id: int = 1, vocabulary: int = 49_408, level: int = 3) -> None:
    """All documents' ids as token-id files under ``out``."""
    import zstandard

    spark, width = docs.sparkSession, 2 if vocabulary <= 1 << 16 else 4
    dictionary = train(docs, path, end_id, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, end = dropped(path, width), end_id.to_bytes(width, "little")
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        part, block, index, frames, at = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            known = [x["doc_id"] for x in index if x["doc_id"] is not None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None, "n_docs": len(index), "n_tokens": sum(x["n_ids"] for x in index),
                "width": width, "dict_sha256": sha, "index": index, "payload": b"".join(frames),
            }], schema=arrow)

        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                for doc, raw in zip(ids, units.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])):
                    frame = press.compress(body := raw + end)
                    index.append({"doc_id": doc, "offset": at, "length": len(frame), "n_ids": len(body) // width})
                    frames.append(frame)
                    at += len(frame)
                    if at >= BLOCK_BYTES or len(index) >= BLOCK_DOCS:
                        yield row()
                        block, index, frames, at = block + 1, [], [], 0
        if index:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(BLOCK_SCHEMA)
    arrow = to_arrow_schema(schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(blocks, schema).write.parquet(f"{out}/blocks")


def read(spark: SparkSession, out: str) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, little-endian)."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    head = blocks.select("part", "block", "n_tokens")
    parts = starts_of(head.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n").select("part", F.col("start").alias("_part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = head.select("part", "block", inner.alias("_in")).join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_in")).alias("start"))
    return blocks.select("part", "block", "width", "dict_sha256", "index", "payload").join(starts, ["part", "block"]).select("start", "width", "dict_sha256", "index", "payload").mapInArrow(unpacker(spark, out), "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (or of all that share the id): only the blocks whose range holds it, only its frames."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    hits = blocks.select("width", "dict_sha256", "payload", F.explode(F.filter("index", lambda x: x.doc_id == doc_id)).alias("x"))
    frames = hits.select("dict_sha256", "width", F.col("payload").substr(F.col("x.offset") + 1, F.col("x.length")).alias("frame")).collect()
    press = decompressor(spark, out)
    return [np.frombuffer(press[r.dict_sha256].decompress(bytes(r.frame)), f"<u{r.width}").astype(np.uint32) for r in frames]


def dictionaries(spark: SparkSession, out: str) -> dict[str, bytes]:
    found = {r.dict_sha256: bytes(r.dictionary) for r in spark.read.parquet(f"{out}/dictionary").collect()}
    for sha, body in found.items():
        if hashlib.sha256(body).hexdigest() != sha:
            raise ValueError(f"the dictionary does not have its hash {sha}")
    return found


def decompressor(spark: SparkSession, out: str) -> dict:
    import zstandard

    return {sha: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) for sha, body in dictionaries(spark, out).items()}


def unpacker(spark: SparkSession, out: str):
    known = dictionaries(spark, out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = {sha: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) for sha, body in known.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                start, width, sha, index, payload = (batch.column(k)[i].as_py() for k in range(5))
                docs, starts, counts, ids = [], [], [], []
                for x in index:
                    body = press[sha].decompress(payload[x["offset"] : x["offset"] + x["length"]])
                    ids.append(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes())
                    docs.append(x["doc_id"])
                    starts.append(start)
                    counts.append(x["n_ids"])
                    start += x["n_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return unpack


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: ids of all documents written to files and read back."""
    import public_tokenizers

    out = scratch(spark, "token-files")
    write(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
