"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints. A text is lower-cased (A-Z), cut into words of ``[^\\x20\\x09-\\x0D]+``, and every 4-word shingle, repeats
included, is hashed by XXH64 with seed 42; a bit is set if it is set in over half of the hashes. Fewer words make one
shingle, no words the fingerprint zero, which links like any other.

Links. Two fingerprints link at ``distance`` (4) differing bits or fewer. Equal fingerprints are joined first, so that
copies are one node. Of 6 blocks of bits, a linked pair agrees in 2 at least; so for each of the 15 pairs of blocks the
fingerprints that agree there meet in one bucket, and no pair is missed. A bucket of too many is dealt again in the same
way by the bits outside its two blocks, so the size of a bucket is bounded. In a bucket they are sorted by Gray rank, which
puts patterns with few differing bits side by side, and an index is built over runs of that order: an upper node holds
the bits that all below it share (a mask and a pattern), a lower node only what its upper nodes do not hold. A search
goes down level by level for all fingerprints of a batch at once, adds up the differences of the patterns passed,
prunes whole groups above ``distance``, and takes whole groups that must lie within it. Fingerprints that are linked
already are not compared again, and a bucket yields a spanning set of links, not all pairs.

Components. Links between nodes (a node is a fingerprint, whatever ids its rows have) are contracted to stars by rounds of
large-star and small-star until nothing changes, each round cut by a checkpoint.

Defined results: a null text has no words; null ids are not returned by SQL comparison but keep their row, with their
fingerprint and the component of it (a component of null ids alone is null); repeated rows are kept each; very long texts
are read whole, 65,536 shingles at a time; an empty table gives an empty result; other columns are ignored. The rounds of
stars grow with the logarithm of the longest chain; if ``rounds`` (40) do not settle it, that is an error, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import cut, map_texts, only, with_found
from kinoframe.llm.exact_dedup import keeper, located, scanned, without_rows

SHINGLE, DISTANCE, BLOCKS, FAN = 4, 4, 6, 8
#: Pairs (fingerprint, node) that a search holds at once.
FRONTIER = 1 << 20
#: Fingerprints of a bucket that one task searches: as many as 20 bits tell apart.
HOT = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text, unsigned."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh(b" ".join(words), 42)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = len(words) - shingle + 1
    hashes = np.array([xxh(line[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for rows of (doc_id, text)."""

    def make():
        def work(ids, texts):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return {"doc_id": ids, "fp": pa.array(found.view(np.int64))}

        return work

    return map_texts(docs, make, "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a pattern in the reflected Gray order: each bit is the parity of the bits from the top down to it."""
    y = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        y ^= y >> np.uint64(s)
    return y


class Index:
    """Hierarchical index over fingerprints that lie bucket by bucket in Gray order."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray, fan: int = FAN):
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = []  # leaves first: (pattern, mask of shared bits, first leaf, last leaf + 1, first child, last child + 1)
        pattern, mask, group = fps, np.full(len(fps), ones), bucket
        lo = np.arange(len(fps))
        hi, child = lo + 1, lo
        child_hi = hi
        while True:
            self.levels.append([pattern, mask, lo, hi, child, child_hi])
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            if (sizes == 1).all():
                break
            # runs of ``fan`` nodes of a bucket
            within = np.arange(len(group)) - np.repeat(starts, sizes)
            first = np.flatnonzero(within % fan == 0)
            stop = np.r_[first[1:], len(group)]
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ np.repeat(pattern[first], stop - first)), first)
            pattern, mask, group = pattern[first] & shared, shared, group[first]
            lo, hi = lo[first], hi[stop - 1]
            child, child_hi = first, stop
        self.root_of = np.repeat(np.arange(len(group)), hi - lo)
        # a lower node keeps only the bits its upper node does not hold
        self.rest = []
        for (_, mask, *_), (_, above, _, _, c, ch) in zip(self.levels, self.levels[1:]):
            self.rest.append(mask & ~np.repeat(above, ch - c))
        self.rest.append(self.levels[-1][1])
        self.free = [64 - popcount(x[1]) for x in self.levels]

    def search(self, fps: np.ndarray, who: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (leaf, later leaf of its bucket) within ``distance`` that join different labels, level by level."""
        out_a, out_b = [], []
        stack = [(len(self.levels) - 1, who, self.root_of[who], np.zeros(len(who), np.int16))]
        same = self.uniform(label)
        while stack:
            level, q, node, passed = stack.pop()
            pattern, _, lo, hi, child, child_hi = self.levels[level]
            near = passed + popcount((fps[q] ^ pattern[node]) & self.rest[level][node])
            # later leaves only; groups that carry the fingerprint's own label are done
            keep = (near <= distance) & (hi[node] > q + 1) & (same[level][node] != label[q])
            q, node, near = q[keep], node[keep], near[keep]
            if level == 0:
                out_a.append(q)
                out_b.append(node)
                continue
            sure = near + self.free[level][node] <= distance  # all below lies within: one link to each
            for a, n in ((q[sure], node[sure]),):
                sizes = hi[n] - lo[n]
                out_a.append(np.repeat(a, sizes))
                out_b.append(np.repeat(lo[n] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
            q, node, near = q[~sure], node[~sure], near[~sure]
            sizes = child_hi[node] - child[node]
            ends = np.cumsum(sizes)
            for a, b in pieces(ends, FRONTIER):
                s = sizes[a:b]
                stop = np.cumsum(s)
                down = np.repeat(child[node[a:b]] - stop + s, s) + np.arange(s.sum())
                stack.append((level - 1, np.repeat(q[a:b], s), down, np.repeat(near[a:b], s)))
        return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """The label that all leaves of a node carry, or -1."""
        out = [label]
        for _, _, _, _, child, child_hi in self.levels[1:]:
            below = out[-1]
            low, high = np.minimum.reduceat(below, child), np.maximum.reduceat(below, child)
            out.append(np.where(low == high, low, -1))
        return out


def pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the least label of each component, by hooking and pointer jumping."""
    label = label.copy()
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    while (label[label] != label).any():
        label = label[label]
    return label


def local_links(keys: np.ndarray, fps: np.ndarray, distance: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a spanning set of links among rows that share a key."""
    order = np.lexsort((gray_rank(fps), keys))
    k, f = keys[order], fps[order]
    # a bucket of one has no links
    edge = np.r_[True, k[1:] != k[:-1]]
    size = np.diff(np.r_[np.flatnonzero(edge), len(k)])
    many = np.repeat(size > 1, size)
    order, k, f = order[many], k[many], f[many]
    if not len(f):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = Index(f, k)
    label = np.arange(len(f))
    for a in range(0, len(f), chunk):
        x, y = index.search(f, np.arange(a, min(a + chunk, len(f))), label, distance)
        if len(x):
            label = merge(label, x, y)
    linked = np.flatnonzero(label != np.arange(len(f)))
    return order[label[linked]], order[linked]


def block_masks(free: int = (1 << 64) - 1, blocks: int = BLOCKS) -> list[int]:
    """The bits of ``free`` cut into blocks of about equal sizes."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def tables_in(mask: int, distance: int, blocks: int) -> list[int]:
    """Masks, ``mask`` included, of which fingerprints that agree in it and link agree in one at least."""
    rest = block_masks(((1 << 64) - 1) & ~mask, blocks)
    return [mask | sum(c) for c in combinations(rest, blocks - distance)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between nodes (node, fp) of different fingerprints: their components are those of all links.

    A bucket of more than ``hot`` fingerprints is dealt again by blocks of the bits that they need not share, until buckets
    are small or leave 20 bits free, so that they cannot be larger: no task holds more than ``HOT`` rows of a bucket.
    """
    n, masks, found = nodes.count(), [0], []
    rows = nodes.select("node", "fp", F.lit(0).alias("t"))
    while True:
        # 15 masks for each of the level before: 15, 225, 3375, whatever the input
        deals = [tables_in(mask, distance, blocks) for mask in masks]
        own = F.get(F.lit([[signed(m) for m in deal] for deal in deals]).cast("array<array<bigint>>"), F.col("t"))
        dealt = rows.select("node", "fp", "t", F.posexplode(own).alias("i", "m"))
        spread = dealt.select((F.col("t") * len(deals[0]) + F.col("i")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp", "node")
        masks = [m for deal in deals for m in deal]
        if n <= hot or max(64 - m.bit_count() for m in masks) < HOT.bit_length():
            break
        large = cut(spread.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key"))
        if large.isEmpty():
            break
        found.append(bucket_links(spread.join(large, ["t", "key"], "left_anti"), distance))
        rows = spread.join(large, ["t", "key"], "left_semi").select("node", "fp", "t")
    found.append(bucket_links(spread, distance))
    return reduce(DataFrame.unionByName, found)


def bucket_links(spread: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within the buckets of (t, key, fp, node), which are tasks' work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t, key, fp, node):
            # one table after the other, each bucket whole
            for i in np.unique(t):
                rows = np.flatnonzero(t == i)
                a, b = local_links(key[rows], fp[rows].view(np.uint64), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(node[rows[a]]), pa.array(node[rows[b]])], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            rows += batch.num_rows
            if rows >= 1 << 18:
                t, key, fp, node = (np.concatenate(c) for c in zip(*held))
                # rows come sorted by (t, key), so that only the last bucket may go on
                last = len(t) - 1 - int(np.argmin(((t == t[-1]) & (key == key[-1]))[::-1])) + 1 if not ((t == t[-1]) & (key == key[-1])).all() else 0
                if last:
                    yield from found(t[:last], key[:last], fp[:last], node[:last])
                held, rows = [[t[last:], key[last:], fp[last:], node[last:]]], len(t) - last
        if rows:
            yield from found(*(np.concatenate(c) for c in zip(*held)))

    parts = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of all nodes with links: the least node each can reach, by large-star and small-star rounds."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # large-star: the larger neighbours of a node go to the least of its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.where("a <> b").distinct())
        # stars all: every node with a parent has one, and no parent has a parent
        tops = after.select(F.col("b").alias("a")).distinct()
        done = after.groupBy("a").count().where("count > 1").isEmpty() and after.join(tops, "a", "left_semi").isEmpty()
        edges = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars


def kept_of(prints: DataFrame, keep: Column, distance: int, blocks: int) -> DataFrame:
    """(fp, kept): of each fingerprint's component, the least ``keep`` of all rows."""
    nodes = cut(prints.groupBy("fp").agg(F.min(keep).alias("least")))
    stars = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance, blocks))
    named = nodes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    kept = named.groupBy("component").agg(F.min("least").alias("kept"))
    return named.join(kept, "component").select("fp", "kept")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for rows of (doc_id, text)."""
    prints = cut(fingerprints(docs, shingle))
    named = kept_of(prints, F.col("doc_id"), distance, blocks)
    # a fingerprint of very many copies is one row here and many there, which adaptive execution splits
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.col("kept").alias("component_id"))


def deduplicate(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, blocks: int = BLOCKS, plain_scan: bool = False) -> DataFrame:
    """Of each component one row of ``docs`` stays, with its columns: the one with the smallest doc_id, null ids last;
    among rows that share the id, the first by file and row. ``plain_scan``: see ``exact_dedup``."""
    docs = scanned(docs, plain_scan, "near-dedup-input")

    def make():
        return lambda texts: np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)

    rows = located(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_file", "_row")
    prints = cut(with_found(rows, make, "fp", "long").select("fp", keeper().alias("own")))
    named = kept_of(prints, F.col("own"), distance, blocks)
    return without_rows(docs, prints.join(named, "fp").where("own._file <> kept._file or own._row <> kept._row").select("own._file", "own._row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's fingerprint and component."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
