"""Alignment of two tokenizers' tokens over the bytes of a text, as joins and windows.

Both tokenizers always cut before a single blank or line end that has no other white space beside it, so a text is a row of
*stretches* between such places and its tokens are those of its stretches, one after another. Stretches repeat: each
distinct one is encoded once in the whole corpus and aligned once, relationally. Its tokens are exploded with their
positions, a window sums their lengths to the bytes where they end, and both sides meet on stretch and end. An end that both
have is a cut; the running count of cuts numbers the groups. Between two neighbouring ends lies one token of either side, so
every end is one link, of the next token of A with the next of B: links grow with the tokens, never with their product.

Documents are put together from their stretches by *blocks*: rows of about ``BLOCK`` bytes of text, whose stretches are
numbered, so that a document is an array of small numbers and a block's stretches are joined once for all its documents. The
``frequent`` stretches of a bounded sample have the same numbers in every block and reach the tasks as one table of at most
that many rows; all others are sent to the blocks that hold them, so the table changes what is sent, never a result. A link's
count is that of the documents that hold its pair of ids; counts are summed in a block before they are shuffled. The
``pairs`` of the highest counts are looked up in a table of at most that many rows, the rest are joined.

Defined results: a null or empty text, and one whose tokens do not give the bytes of the text back (it holds U+2581, say), has
no tokens and no links, also in the counts; null and repeated ids are rows as any, and repeated texts count as documents;
a text without places to cut is one stretch, however long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinoframe.llm.base import drop_scratch, only, slices, stored

#: Bytes of text whose stretches are numbered together.
BLOCK = 4 << 20
#: Stretches and pairs that tasks have at hand, documents of the sample that the stretches are picked from, and their characters at most.
FREQUENT, PAIRS, SAMPLE, CHARS = 1 << 17, 1 << 16, 5000, 40
MARK = "▁"
#: A stretch begins at a blank or line end with nothing white beside it; any other white space is inside.
STRETCH = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S*)*|\s+")
BLOCKS = "block long, row int, doc_id long, places array<int>, stretches array<string>"


def stretches(text: str) -> list[str]:
    """The stretches of a text with the blank in front."""
    return STRETCH.findall(f" {text}") if text else []


class Pair:
    """Both tokenizers over stretches, with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # the letters of byte-level tokens: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
        own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
        letter = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
        if set(letter) != set(ByteLevel.alphabet()):
            raise ValueError("not a byte-level vocabulary")
        self.bytes_a = {i: bytes(letter[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in letter for c in t)}
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces may go on past a blank or line end: texts cannot be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = b.piece_to_id(MARK)

    def encode(self, units: list[str]) -> dict[str, list]:
        """Ids and lengths in bytes of both; empty where the bytes of either are not those of the stretch."""
        out: dict[str, list] = {"a": [], "a_bytes": [], "b": [], "b_bytes": []}
        left = self.a.encode_batch_fast(units, add_special_tokens=False)
        right = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for unit, x, b in zip(units, left, right):
            a, plain = x.ids, unit.encode()
            if unit[0] != " ":
                b = b[1:] if b[0] == self.mark else []  # the blank that is put in front stands alone before a line end
            own_a, own_b = [self.bytes_a.get(i, b"") for i in a], [self.bytes_b[i] for i in b]
            if b"".join(own_a) != plain or b"".join(own_b) != plain:
                a, b, own_a, own_b = [], [], [], []
            for name, value in zip(out, (a, map(len, own_a), b, map(len, own_b))):
                out[name].append(list(value))
        return out


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def frequent(docs: DataFrame, room: int = FREQUENT, sample_docs: int = SAMPLE) -> list[str]:
    """The commonest stretches of a sample of documents that is picked by a hash of the id; they bound what is sent, not what is read."""
    if room < 1:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                own = Counter(u for t in batch.column(0).slice(a, b - a).to_pylist() for u in stretches(t or "") if len(u) <= CHARS)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(own.values(), pa.int64())], names=["stretch", "n"])

    every = max(1, docs.count() // sample_docs)
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    best = part.mapInArrow(run, "stretch string, n long").groupBy("stretch").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "stretch").limit(room)
    return best.toArrow()["stretch"].to_pylist()


def blocks(docs: DataFrame, size: int = BLOCK, known: list[str] | None = None) -> DataFrame:
    """Rows of (doc_id, text) as places in ``known`` and after it in their block's own stretches, which the first row of a block holds."""
    known = known or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, base = TaskContext.get().partitionId() << 32, {u: k for k, u in enumerate(known)}
        for batch in batches:
            for a, b in slices(batch.column(1), size):
                index = base.copy()
                places = [np.array([index.setdefault(u, len(index)) for u in stretches(t or "")], np.int32) for t in batch.column(1).slice(a, b - a).to_pylist()]
                units = [list(islice(index, len(base), None)), *[None] * (b - a - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * (b - a), pa.int64()), pa.array(range(b - a), pa.int32()), batch.column(0).slice(a, b - a), pa.array(places, pa.list_(pa.int32())), pa.array(units, pa.list_(pa.string()))],
                    names=["block", "row", "doc_id", "places", "stretches"],
                )
                block += 1

    return docs.mapInArrow(run, BLOCKS)


def holders(rows: DataFrame, known: list[str]) -> DataFrame:
    """Distinct stretches: ``common``, the place among ``known`` if it has one, else ``held``, where the blocks have it."""
    own = rows.where(F.col("stretches").isNotNull()).select(F.lit(None).cast("int").alias("common"), F.col("block").alias("in_block"), F.posexplode("stretches").alias("place", "stretch"))
    own = own.select("stretch", "common", F.struct("in_block", F.expr(f"place + {len(known)}").alias("place")).alias("at"))
    table = pa.table({"stretch": pa.array(known, pa.string()), "common": pa.array(range(len(known)), pa.int32())})
    every = own.unionByName(rows.sparkSession.createDataFrame(table), allowMissingColumns=True) if known else own
    return every.groupBy("stretch").agg(F.max("common").alias("common"), F.collect_list("at").alias("held"))


def tokens(units: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Distinct stretches, numbered, with their holders and their tokens: ``a`` and ``b``, and the lengths in bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = pair(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 18):
                part = batch.slice(a, b - a)
                found = both.encode(part.column(0).to_pylist())
                ids = pa.array(range(number, number := number + b - a), pa.int64())
                lists = [pa.array(v, pa.list_(pa.int16() if c.endswith("_bytes") else pa.int32())) for c, v in found.items()]
                yield pa.RecordBatch.from_arrays([ids, part.column(1), part.column(2), *lists], names=["id", "common", "held", *found])

    held = units.schema["held"].dataType.simpleString()
    return units.select("stretch", "common", "held").mapInArrow(run, f"id long, common int, held {held}, a array<int>, a_bytes array<smallint>, b array<int>, b_bytes array<smallint>")


def aligned(found: DataFrame) -> DataFrame:
    """The links of each stretch: (id, end, group, a, b, a_ends, b_ends), groups counted from the end of a stretch.

    A null ``a_ends`` or ``b_ends`` says that no token of that side ends there, else it is the token's id.
    """
    side = lambda s: F.transform(F.arrays_zip(s, f"{s}_bytes"), lambda t, i: F.struct(F.lit(s == "a").alias("is_a"), i.alias("pos"), t[s].alias("token"), t[f"{s}_bytes"].alias("bytes")))
    # one exchange of whole stretches: windows and groups by stretch keep its partitioning
    each = found.repartition("id").select("id", F.explode(F.concat(side("a"), side("b"))).alias("t")).select("id", "t.*")
    ends = each.withColumn("end", F.sum("bytes").over(Window.partitionBy("id", "is_a").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    met = ends.groupBy("id", "end").agg(F.max(F.when(F.col("is_a"), F.col("token"))).alias("a_ends"), F.max(F.when(~F.col("is_a"), F.col("token"))).alias("b_ends"))
    back = Window.partitionBy("id").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a_ends").isNotNull() & F.col("b_ends").isNotNull()).cast("long")
    return met.select("id", "end", F.sum(cut).over(back).alias("group"), F.last("a_ends", ignorenulls=True).over(back).alias("a"), F.last("b_ends", ignorenulls=True).over(back).alias("b"), "a_ends", "b_ends")


def summed(links: DataFrame) -> DataFrame:
    """A row a stretch: ``n_groups``, and its ``links`` in order, each a number: the id of A from bit 33 on, that of B from bit 2
    on, and whether A's (2) and B's (1) token ends there."""
    code = F.shiftleft(F.col("a").cast("long"), 33) + F.shiftleft(F.col("b").cast("long"), 2) + F.col("a_ends").isNotNull().cast("long") * 2 + F.col("b_ends").isNotNull().cast("long")
    each = links.groupBy("id").agg(F.max("group").alias("n_groups"), F.array_sort(F.collect_list(F.struct("end", code.alias("code")))).alias("links"))
    return each.select("id", "n_groups", F.col("links.code").alias("links"))


def cut_at(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists one after another, and where each list begins and the last ends."""
    whole = lists.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    return whole.flatten().to_numpy(), np.append(0, np.cumsum(whole.value_lengths().to_numpy()))


def groups_of(links: list[int]) -> str:
    """A stretch's groups in text: ids of A and B that end up to a cut."""
    out, a, b = [], [], []
    for x in links:
        if x & 2:
            a.append(str(x >> 33))
        if x & 1:
            b.append(str(x >> 2 & 0x7FFFFFFF))
        if x & 3 == 3:
            out.append(f"{','.join(a)}|{','.join(b)}")
            a, b = [], []
    return ";".join(out)


_ready: dict[str, object] = {}


def ready(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, once a process for as long as the same key is asked for."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = make()
    return _ready[key]


def described(known: pa.Table, first: int, size: int) -> tuple[np.ndarray, ...]:
    """Of the stretches at ``size`` places from ``first`` on: the pairs of all one after another, then for each place where they
    begin, how many they are, (n_a, n_b, n_groups, n_links) and the groups in text; nothing for places that are not known."""
    flat, ends = cut_at(known["links"])
    place = known["place"].to_numpy() - first
    begin, length, table = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
    begin[place], length[place] = ends[:-1], np.diff(ends)
    upto = np.concatenate([[[0, 0]], np.cumsum(np.stack([flat >> 1 & 1, flat & 1], 1), 0)]) if len(flat) else np.zeros((1, 2), np.int64)
    table[place, :2] = upto[ends[1:]] - upto[ends[:-1]]
    table[place, 2], table[place, 3] = known["n_groups"].to_numpy(), length[place]
    texts, numbers = np.full(size, None, object), flat.tolist()
    texts[place] = [groups_of(numbers[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return flat >> 2, begin, length, table, texts


def assembled(rows: DataFrame, words: DataFrame, common: pa.Table, size: int) -> DataFrame:
    """Documents from their stretches (``words``: in_block, place, n_groups, links; ``common``: place, n_groups, links of places
    below ``size``, the same in every block): (block, row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256), and for each block
    and pair a row with ``link`` and ``n``, its documents that hold the pair.

    A document with a stretch that is in neither has no tokens.
    """
    schema = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link long, n long"
    sums, kinds = ["n_a", "n_b", "n_groups", "n_links"], {"row": pa.int32(), "groups_sha256": pa.string()}
    kinds = {c: kinds.get(c, pa.int64()) for c in ("block", "row", "doc_id", *sums, "groups_sha256", "link", "n")}
    key = uuid.uuid4().hex

    def begun() -> tuple:
        shared = described(common, 0, size)
        return shared, *np.unique(shared[0], return_inverse=True)

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        shared, names, own = ready(key, begun)
        last = max(size, 1 + int(max(known["place"].to_numpy(), default=-1)))  # this place stands for all that are not known
        pairs, begin, length, table, texts = described(known, size, last - size + 1)
        begin, length = np.concatenate([shared[1], begin + len(own)]), np.concatenate([shared[2], length])
        table, texts = np.concatenate([shared[3], table]), np.concatenate([shared[4], texts])
        fresh = np.setdiff1d(pairs, names)
        spot = np.minimum(np.searchsorted(names, pairs), max(len(names) - 1, 0))
        new = np.isin(pairs, fresh)
        own = np.concatenate([own, np.where(new, len(names) + np.searchsorted(fresh, pairs), spot)])
        names = np.concatenate([names, fresh])
        places, cuts = cut_at(docs["places"])
        found, digests, count = np.zeros((len(docs), 4), np.int64), [""] * len(docs), np.zeros(len(names), np.int64)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            at = np.minimum(places[a:b], last)
            if len(at) and length[at].all():
                found[i] = table[at].sum(0)
                digests[i] = hashlib.sha256(";".join(texts[at].tolist()).encode()).hexdigest()
                at = np.unique(at)
                n = length[at]
                count[np.unique(own[np.arange(n.sum()) + np.repeat(begin[at] - np.cumsum(n) + n, n)])] += 1
        held = count > 0
        none = [None] * int(held.sum())
        columns = {c: docs[c].to_pylist() + none for c in ("block", "row", "doc_id")}
        columns |= {s: found[:, k].tolist() + none for k, s in enumerate(sums)} | {"groups_sha256": digests + none}
        columns |= {"link": [None] * len(docs) + names[held].tolist(), "n": [None] * len(docs) + count[held].tolist()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    each = rows.select("block", "row", "doc_id", "places").groupBy("block").cogroup(words.select("in_block", "place", "n_groups", "links").groupBy("in_block"))
    return each.applyInArrow(run, schema)


def counted(parts: DataFrame) -> DataFrame:
    """(link, n, best): every pair of ids, the documents that hold it, and whether no pair of its A id is in more."""
    counts = parts.where("link is not null").groupBy("link").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("link", 31)))).cast("long"))


def weights(infos: DataFrame, known: DataFrame, room: int = PAIRS) -> DataFrame:
    """(id, common, held, n_best, count_sum): over the links of a stretch, those of the highest count of their A id, and all counts.

    ``known`` has all pairs; ``room`` of them, those in most documents, are looked up where the stretches are, the rest joined.
    """
    top = known.orderBy(F.desc("n"), "link").limit(room).toArrow().sort_by("link").to_pydict() if room > 0 else {"link": [], "n": [], "best": []}
    # a last row of its own is what pairs that are not in the table find
    links, worth = np.array([*top["link"], -1], np.int64), np.array([[*top["best"], 0], [*top["n"], 0]], np.int64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = cut_at(pa.chunked_array([batch.column(3)]))
            flat = flat >> 2
            spot = np.searchsorted(links[:-1], flat)
            lost = links[spot] != flat
            spot[lost] = len(links) - 1
            upto = np.concatenate([[[0, 0]], np.cumsum(worth[spot], 0)])
            sums, upto = upto[ends[1:]] - upto[ends[:-1]], np.append(0, np.cumsum(lost))[ends]
            rest = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat[lost], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[:, 0]), pa.array(sums[:, 1]), rest], names=["id", "common", "held", "n_best", "count_sum", "rest"])

    held = infos.schema["held"].dataType.simpleString()
    each = infos.select("id", "common", "held", "links").mapInArrow(run, f"id long, common int, held {held}, n_best long, count_sum long, rest array<long>")
    if len(links) <= room:  # no pair is left out
        return each.drop("rest")
    more = each.select("id", F.explode("rest").alias("link")).join(known, "link").groupBy("id").agg(F.sum("best").alias("more_best"), F.sum("n").alias("more"))
    add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return each.join(more, "id", "left").select("id", "common", "held", add("n_best", "more_best"), add("count_sum", "more"))


def weighed(rows: DataFrame, words: DataFrame, common: pa.Table, size: int) -> DataFrame:
    """(block, row, n_best, count_sum) of all documents; of one with an unknown stretch they mean nothing."""
    key = uuid.uuid4().hex

    def values(known: pa.Table, first: int, size: int) -> np.ndarray:
        table = np.zeros((size, 2), np.int64)
        table[known["place"].to_numpy() - first] = np.stack([known[c].to_numpy() for c in ("n_best", "count_sum")], 1)
        return table

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        last = max(size, 1 + int(max(known["place"].to_numpy(), default=-1)))
        table = np.concatenate([ready(key, lambda: values(common, 0, size)), values(known, size, last - size + 1)])
        places, cuts = cut_at(docs["places"])
        upto = np.concatenate([[[0, 0]], np.cumsum(table[np.minimum(places, last)], 0)])
        found = upto[cuts[1:]] - upto[cuts[:-1]]
        return pa.table({"block": docs["block"], "row": docs["row"], "n_best": found[:, 0], "count_sum": found[:, 1]})

    each = rows.select("block", "row", "places").groupBy("block").cogroup(words.groupBy("in_block"))
    return each.applyInArrow(run, "block long, row int, n_best long, count_sum long")


def dealt(found: DataFrame, *columns: str) -> tuple[DataFrame, pa.Table]:
    """The stretches of the blocks, (in_block, place, ...), and the table of those that all blocks share, (place, ...)."""
    own = found.select(F.explode("held").alias("at"), *columns).select("at.in_block", "at.place", *columns)
    return own, found.where(F.col("common").isNotNull()).select(F.col("common").alias("place"), *columns).toArrow()


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, room: int = FREQUENT, pairs: int = PAIRS
) -> DataFrame:
    """doc_id and what its alignment holds, a row for each row of ``docs``. ``room`` and ``pairs`` bound the tables at hand."""
    done: list[str] = []
    docs = only(docs, id_col, text_col)
    known = frequent(docs, room)
    rows = stored(blocks(docs, block, known), "alignment-blocks", codec="zstd")
    found = stored(tokens(holders(rows, known), path_a, path_b), "alignment-tokens", done, "zstd")
    infos = stored(summed(aligned(found)).join(found.select("id", "common", "held"), "id"), "alignment-stretches", codec="zstd")
    drop_scratch(docs.sparkSession, *done)
    parts = stored(assembled(rows, *dealt(infos, "n_groups", "links"), len(known)), "alignment-documents", codec="zstd")
    counts = stored(counted(parts), "alignment-pairs", codec="zstd")
    sums = weighed(rows, *dealt(weights(infos, counts, pairs), "n_best", "count_sum"), len(known))
    found = parts.where("row is not null").drop("link", "n").join(sums, ["block", "row"])
    with_tokens = lambda c: F.when(F.col("n_a") > 0, F.col(c)).otherwise(F.lit(0)).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", with_tokens("n_best"), with_tokens("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document, byte-level tokens against pieces."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
