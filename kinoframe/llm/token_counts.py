"""Token counts of sections: offset-mapped attribution.

A document is encoded once and whole; every token has a span of characters. The spans are interval-joined with the
document's sections (stretches of characters), and each token is given out by an explicit rule:

- ``start``: to the section that holds its first character;
- ``most``: to the section that holds most of its characters, the first of equals;
- ``share``: to every section it meets, by its share of characters (counts are then fractions).

A token of which no character lies in a section counts for none (``section`` null in the result, where there are any).
Counts over a document's sections and that row always sum to the document's tokens.

Sections come from a function of the text (``lines``: each line with its line end) or, where ``given`` names two array
columns, from those: ``with_spans`` gathers them from a table of fields, a document's own, which its length bounds.

Defined results: a null or empty text has one section, 0 to 0, without tokens; a very long text is encoded whole; sections
need no order, and may leave gaps and overlap: a character in several belongs to the innermost, the one that begins last (of
those the shortest, then the last given), so no token counts twice; a null bound or one that ends before it begins is empty,
as is a section outside the text; null ids are kept, with no fields of a table; repeated rows count each; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinoframe.llm.base import only, slices
from kinoframe.llm.tokens import Led

RULES = ("start", "most", "share")
SCHEMA = "doc_id long, sections array<struct<section: int, begin: int, end: int, n_tokens: double, n_crossing: long>>"


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A section a line, its line end included; they cover the text."""
    if not text:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    sizes = np.array([len(x) + 1 for x in text.split("\n")])
    sizes[-1] -= 1
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def disjoint(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches in order that do not overlap, and the section that owns each: of several the innermost."""
    order = np.lexsort((-ends, begins))
    order = order[ends[order] > begins[order]]
    b, e = begins[order], ends[order]
    if not len(order) or (b[1:] >= e[:-1]).all():
        return b, e, order
    out: list[tuple[int, int, int]] = []
    open_: list[int] = []  # sections that hold the place reached, the innermost last
    at = 0

    def close(upto: int | None) -> None:
        """Give out what lies before ``upto``; drop sections that end by then."""
        nonlocal at
        while open_ and (upto is None or at < upto):
            s = open_[-1]
            stop = int(ends[s]) if upto is None else min(int(ends[s]), upto)
            if stop > at:
                out.append((at, stop, s))
                at = stop
            if ends[s] <= at:
                open_.pop()
        if upto is not None:
            at = upto

    for s in order.tolist():
        close(int(begins[s]))
        open_.append(s)
    close(None)
    b, e, owner = (np.array(c, np.int64) for c in zip(*out))
    return b, e, owner


def attribute(spans: np.ndarray, begins: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and, last, of none; and how many tokens of each section cross its bounds."""
    k = len(begins)
    counts, crossing = np.zeros(k + 1), np.zeros(k + 1, np.int64)
    if not len(spans):
        return counts, crossing
    begins, ends, owner = disjoint(begins, ends)
    m = len(begins)
    if not m:
        counts[k] = len(spans)
        return counts, crossing
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    # the first stretch that ends after a token begins, and the last that begins before it ends
    first = np.searchsorted(ends, a, "right")
    last = np.searchsorted(begins, b, "left") - 1
    at = np.minimum(first, m - 1)
    inside = (first == last) & (begins[at] <= a) & (ends[at] >= b)
    counts += np.bincount(owner[first[inside]], minlength=k + 1)
    counts[k] += int((first > last).sum())
    # tokens that meet a bound: a row for each stretch that one meets
    rest = np.flatnonzero(~inside & (first <= last))
    if not len(rest):
        return counts, crossing
    met = last[rest] - first[rest] + 1
    token = np.repeat(rest, met)
    stretch = np.repeat(first[rest] - np.cumsum(met) + met, met) + np.arange(met.sum())
    own, size = owner[stretch], np.minimum(b[token], ends[stretch]) - np.maximum(a[token], begins[stretch])
    # of one owner's stretches that a token meets: one row
    order = np.lexsort((own, token))
    token, own, size, stretch = token[order], own[order], size[order], stretch[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])]
    size = np.add.reduceat(size, np.flatnonzero(new))
    holds = np.bitwise_or.reduceat((begins[stretch] <= a[token]) & (ends[stretch] > a[token]), np.flatnonzero(new))
    token, own = token[new], own[new]
    if rule == "share":
        part = size / (b - a)[token]
        np.add.at(counts, own, part)
        np.add.at(crossing, own, 1)
        none = 1 - np.bincount(np.searchsorted(rest, token), part, len(rest))
        counts[k] += none[none > 1e-9].sum()
        crossing[k] += int((none > 1e-9).sum())
        return counts, crossing
    if rule == "most":
        best = np.lexsort((own, -size, token))
        best = best[np.r_[True, token[best][1:] != token[best][:-1]]]
        to = own[best]
    else:
        to = np.full(len(rest), k)
        to[np.searchsorted(rest, token[holds])] = own[holds]
    counts += np.bincount(to, minlength=k + 1)
    crossing += np.bincount(to, minlength=k + 1)
    return counts, crossing


def bounds(begins: list | None, ends: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Given sections; one with a null bound is empty, and what one array has more than the other is left out."""
    pairs = [(0, 0) if x is None or y is None else (x, max(x, y)) for x, y in zip(begins or [], ends or [])]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def count_tokens(docs: DataFrame, path: str, rule: str = "start", cut: Callable[[str], tuple] = lines, given: tuple[str, str] | None = None) -> DataFrame:
    """A row a section for rows of (doc_id, text). ``given``: the columns that hold each row's sections as arrays."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Led(path, spans=True)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [bounds(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())] if given else [cut(t) for t in texts]
                rows = ([], [], [], [], [])
                sizes = []
                for spans, (begins, ends) in zip(units.encode(texts), found):
                    counts, crossing = attribute(spans, begins, ends, rule)
                    k = len(begins)
                    none = bool(counts[k])
                    sizes.append(k + none)
                    rows[0].extend(range(k))
                    rows[1].extend(begins.tolist())
                    rows[2].extend(ends.tolist())
                    rows[3].extend(counts[: k + none].tolist())
                    rows[4].extend(crossing[: k + none].tolist())
                    if none:
                        for c in rows[:3]:
                            c.append(None)
                fields = arrow.field("sections").type.value_type
                flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(rows, fields)], fields=list(fields))
                offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat, type=arrow.field("sections").type)], schema=arrow)

    arrays = [F.col(f"`{c}`").cast("array<int>") for c in given or ()]
    return docs.select("doc_id", "text", *arrays).mapInArrow(run, schema).select("doc_id", F.inline("sections"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) with the (doc_id, begin, end) rows of a table of fields gathered as arrays ``begins`` and ``ends``."""
    gathered = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("begin"), F.col("end")))).alias("s"))
    return docs.join(gathered, "doc_id", "left").select("doc_id", "text", *[F.coalesce(F.col(f"s.{k}").cast("array<int>"), F.array().cast("array<int>")).alias(f"{k}s") for k in ("begin", "end")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: tokens of every line of every document."""
    import public_tokenizers

    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
