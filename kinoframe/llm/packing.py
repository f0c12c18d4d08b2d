"""Best-fit packing by bin completion.

Pieces of equal length are interchangeable, so the problem is a histogram of at most ``capacity`` lengths, however many
documents there are. That histogram (never a row a document) is packed by branch and bound: around the largest length
left, enumerate the undominated fillings of the bin, of any number of members, drop those whose waste cannot beat the
incumbent, take the tightest first, and apply a filling as often as the counts allow, then once less, down to once. The
first incumbent is best-fit decreasing. The search ends at ``lower_bound``, or when the tree is searched (then no packing has
fewer sequences), or when its budget is spent: ``nodes`` fillings applied or undone, ``tries`` fillings looked at. Where it stopped, the rest is filled by best fit. ``tests`` and README have the gap to
the bound. The plan is a short list of stretches (length, ranks from-to, sequence, offset); pieces find their place by their
rank among pieces of their length. Ranks come from counts by (length, salt), so a length that holds a third of all pieces is
numbered in many tasks.

Defined results: a null or empty text is the end id alone (one token); a very long text is cut into pieces of ``capacity``
tokens; repeated rows are packed each, equal lengths are dealt by id; an empty table gives an empty result; null ids are kept;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinoframe.llm.base import map_texts, only, stored
from kinoframe.llm.tokens import Led

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens; of a longer one the first piece is the shorter one."""

    def make():
        units, end = Led(path), np.array([end_id], "<u4").tobytes()

        def work(ids, texts):
            rows = ([], [], [], [], [])
            for doc, raw in zip(ids, units.encode([t or "" for t in texts])):
                raw += end
                n = len(raw) // 4
                a, b, k = 0, (n - 1) % capacity + 1, 0
                while a < n:
                    for column, v in zip(rows, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                        column.append(v)
                    a, b, k = b, b + capacity, k + 1
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), rows))

        return work

    return map_texts(docs, make, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: fillings and how often each is used.

    Each length, largest first, goes into the fullest open bins that have room for it, else into new ones. Bins that hold
    the same are one entry, so the work follows the number of different fillings, not that of pieces.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {capacity: {}}  # room left -> fillings and their number
    rooms = [capacity]  # in order

    def put(filling: tuple[int, ...], times: int) -> None:
        room = capacity - sum(filling)
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][filling] = open_[room].get(filling, 0) + times

    for n, left in sorted(counts.items(), reverse=True):
        while left > 0:
            at = bisect_left(rooms, n)
            room = rooms[at]
            each = room // n  # a bin that takes one and has room for more is the fullest again
            filling, times = next(iter(open_[room].items())) if open_[room] else ((), left)
            if room != capacity or open_[room]:
                del open_[room][filling]
                if not open_[room] and room != capacity:
                    del open_[room], rooms[at]
                full = min(times, left // each)
            else:
                full = left // each
                times = full + (left % each > 0)
            if full:
                put(filling + (n,) * each, full)
            left -= full * each
            if times > full:
                rest = min(left, each)
                if rest:
                    put(filling + (n,) * rest, 1)
                    left -= rest
                if untouched := times - full - (rest > 0):
                    put(filling, untouched)
    return [(f, t) for fillings in open_.values() for f, t in fillings.items() if f]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each size, pieces that cannot share a bin with one as large stand alone, pieces over
    half stand apart, and what is at least as large must fit into the room these leave."""
    n, sums = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for k, c in counts.items():
        n[k], sums[k] = c, k * c
    n, sums = np.cumsum(n), np.cumsum(sums)  # of all pieces up to a size
    half, best = capacity // 2, 0
    for a in range(half + 1):
        alone, apart = int(n[capacity] - n[capacity - a]), int(n[capacity - a] - n[half])
        spare = apart * capacity - int(sums[capacity - a] - sums[half])
        rest = int(sums[half] - (sums[a - 1] if a else 0))
        best = max(best, alone + apart + max(0, -(-(rest - spare) // capacity)))
    return best


def spread(bits: int, width: int) -> int:
    """``bits`` shifted by 0 to ``width``."""
    done = 1
    while done <= width:
        step = min(done, width + 1 - done)
        bits |= bits << step
        done += step
    return bits


def dominated(s: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether one of the ``spare`` lengths (a bitset) can come into a filling, alone or for members it could hold."""
    one = two = 0  # sums of one member, and of more
    for n in s:
        two |= (two | one) << n
        one |= 1 << n
    larger = spread(one, waste - 1) << 1 if waste else 0
    return bool(spare & (spread(two, waste) | larger | (1 << waste + 1) - 1))


def fillings(left: np.ndarray, largest: int, capacity: int, slack: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated completions of a bin around ``largest`` that waste at most ``slack``, tightest first, then by the
    largest members; None for each dominated one that was looked at.

    A set dominates another whose members can be dealt into its members' sizes. ``left`` must be as it was whenever the
    next one is asked for: the table of sums is made again then, as one for each open choice would fill the memory.
    """
    room = capacity - largest
    now: list[list[int]] = []  # lengths at hand, how many of each can go in, bitsets of the sums of the first i lengths

    def look() -> None:
        here = np.flatnonzero(left[: room + 1])
        count = left[here] - (here == largest)
        here, count = here[count > 0], count[count > 0]
        most = np.minimum(count, room // here).tolist()
        sums = [1]
        for n, c in zip(here.tolist(), most):
            s, part = sums[-1], 1
            while c:
                part = min(part, c)
                s |= s << n * part
                c, part = c - part, 2 * part
            sums.append(s & (1 << room + 1) - 1)
        now[:] = here.tolist(), most, sums

    def deal(i: int, total: int) -> Iterator[tuple[int, ...]]:
        """Members of the first ``i`` lengths with exactly this sum."""
        if not total:
            yield ()
            return
        while i and now[2][i] >> total & 1:
            i -= 1
            n = now[0][i]
            for m in range(min(now[1][i], total // n), 0, -1):
                if now[2][i] >> (total - m * n) & 1:
                    for rest in deal(i, total - m * n):
                        yield (n,) * m + rest

    look()
    small = 0  # sum of all lengths that fit into the waste, which therefore must be members
    for waste in range(min(slack, room) + 1):
        small += sum(n * c for n, c in zip(now[0], now[1]) if n == waste)
        if small > room - waste:
            break
        if now[2][-1] >> (room - waste) & 1:
            for s in deal(len(now[0]), room - waste):
                spare = sum(1 << n for n, c in zip(now[0], now[1]) if c > s.count(n))
                if dominated(s, waste, spare):
                    yield None
                else:
                    now.clear()
                    yield s
                    look()


END = object()


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 6_000, tries: int = 100_000) -> list[tuple[tuple[int, ...], int]]:
    """The fewest bins found for a histogram {length: count}: fillings and how often each is used."""
    counts = {n: c for n, c in counts.items() if c > 0}
    total = sum(n * c for n, c in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    most = sum(t for _, t in best)
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c

    used, bins, waste, budget = [], 0, 0, nodes
    stack: list[tuple[Iterator, tuple]] = []  # open choices, the filling applied at this depth and how often
    options, again = None, None
    while most > least and budget > 0 and tries > 0:
        if options is None:
            here = np.flatnonzero(left)
            if not here.size:
                if bins < most:
                    best, most = list(used), bins
                options = iter(())
            else:
                big = int(here[-1])
                options = fillings(left, big, capacity, (most - 1) * capacity - total - waste)
        step = None
        while step is None:
            if again is not None:
                (s, times), again = again, None
            else:
                if (s := next(options, END)) is END:
                    break
                tries -= 1
                if tries < 0:
                    break
                if s is None:
                    continue
                s = (int(np.flatnonzero(left)[-1]), *s)
                times = min(int(left[n]) // s.count(n) for n in set(s))
            # bins can only be saved while the waste stays below what one bin fewer allows
            spare, each = (most - 1) * capacity - total - waste, capacity - sum(s)
            times = times if not each else min(times, spare // each)
            if times > 0:
                step = (s, times)
        if step:
            for n in step[0]:
                left[n] -= step[1]
            used.append(step)
            bins += step[1]
            waste += step[1] * each
            stack.append((options, step))
            options, budget = None, budget - 1
        elif stack:
            options, (s, times) = stack.pop()
            used.pop()
            for n in s:
                left[n] += times
            bins -= times
            waste -= times * (capacity - sum(s))
            again = (s, times - 1) if times > 1 else None
            budget -= 1
        else:
            break
    if budget <= 0 or tries <= 0:  # where the search was stopped, the rest goes in by best fit
        rest = best_fit({n: int(left[n]) for n in np.flatnonzero(left).tolist()}, capacity)
        if bins + sum(t for _, t in rest) < most:
            best = used + rest
    return best


def stretches(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of every member of every filling, in rank order a length."""
    out, ranks, sequence = [], {}, 0
    for s, times in plan:
        offset = 0
        for n in s:
            out.append((n, ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + times
            offset += n
        sequence += times
    return sorted(out)


def ranked(rows: DataFrame, key: str, salts: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 among the rows of their key, numbered by (key, salt)."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(key, "_salt", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("_own", own).join(starts, [key, "_salt"]).select(*rows.columns, (F.col("_start") + F.col("_own") - 1).alias("rank"))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` in as few sequences as the search finds. ``parts`` is read twice."""
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.array(stretches(complete(counts, capacity)), np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) | table[:, 1]
    salts = max(64, sum(counts.values()) // 200_000)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            cols = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("rank", "length")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(length), pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], names=[*(f.name for f in batch.schema if f.name not in ("rank", "length")), "length", "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes if c != "length") + ", length long, sequence_id long, offset long"
    return ranked(parts, "length", salts).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of (doc_id, text) rows with their places."""
    return pack(stored(pieces(docs, path, end_id, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
