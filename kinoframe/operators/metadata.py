"""Metadata maps, chapters, stream specifiers and stream selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_keys(m: Column, values: dict[str, str]) -> Column:
    """A map with the given keys set; an empty value deletes its key."""
    kept = F.map_filter(m, lambda k, v: ~k.isin(list(values))) if values else m
    new = {k: v for k, v in values.items() if v != ""}
    return F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv])) if new else kept


def copied(to: Column, source: Column) -> Column:
    """``to`` with the keys of ``source`` that it lacks."""
    return F.map_concat(to, F.map_filter(source, lambda k, v: ~F.map_contains_key(to, k)))


def without_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(keys))


def as_text(m: Column) -> Column:
    """``k=v`` pairs in key order, joined by semicolons: a form that compares."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e.key, e.value))), ";")


def entries(rows: DataFrame, m: str, *keep: str) -> DataFrame:
    """A row a key and value."""
    return rows.select(*keep, F.explode(m).alias("key", "value"))


def channel_of(key: Column) -> Column:
    """Channel number of a key that ends in ``.N``; null for others."""
    return F.when(key.rlike(r"\.[0-9]+$"), F.regexp_extract(key, r"\.([0-9]+)$", 1).try_cast("int"))


def clipped_chapters(chapters: DataFrame, start_us: int, duration_us: int) -> DataFrame:
    """Chapters moved by the start and clipped to the recording; those wholly outside go."""
    inside = chapters.where((F.col("end_us") > start_us) & (F.col("start_us") < start_us + duration_us))
    return inside.withColumn("start_us", F.greatest(F.lit(0), F.col("start_us") - start_us)).withColumn("end_us", F.least(F.lit(duration_us), F.col("end_us") - start_us))


KINDS = {"v": "video", "V": "video", "a": "audio", "s": "subtitle", "d": "data", "t": "attachment"}


class Specifier:
    """A stream specifier: kind, program, group, id, metadata, disposition and, last, an index among what matches the rest.

    Terms, joined by colons: a number; ``v a s d t`` or ``V`` (video without attached pictures); ``p:N``; ``g:N``;
    ``#N`` or ``i:N``; ``m:key`` or ``m:key:value`` (which takes the rest); ``disp:name``; ``u`` (usable).
    """

    def __init__(self, text: str):
        self.text, self.terms, self.index = text, [], None
        parts = text.split(":") if text else []
        while parts:
            p = parts.pop(0)
            if re.fullmatch(r"[0-9]+", p):
                if self.index is not None:
                    raise ValueError(f"two indexes in {text!r}")
                self.index = int(p)
            elif p in KINDS:
                self.terms.append(("kind", p))
            elif p == "u":
                self.terms.append(("usable", ""))
            elif p.startswith("#"):
                self.terms.append(("id", number(p[1:], text)))
            elif p in ("p", "g", "i", "disp", "m") and parts:
                if p == "m":
                    self.terms.append(("m", (parts.pop(0), ":".join(parts) if parts else None)))
                    parts = []
                else:
                    v = parts.pop(0)
                    self.terms.append(({"i": "id"}.get(p, p), v if p == "disp" else number(v.lstrip("#") if p == "g" else v, text)))
            else:
                raise ValueError(f"stream specifier {text!r}: {p!r}")

    def condition(self) -> Column:
        """All terms but the index, as a predicate over stream columns."""
        out = F.lit(True)
        for name, v in self.terms:
            if name == "kind":
                out &= F.col("kind") == KINDS[v]
                if v == "V":
                    out &= ~F.col("attached_pic")
            elif name == "m":
                value = F.try_element_at("metadata", F.lit(v[0]))
                out &= value.isNotNull() if v[1] is None else F.coalesce(value == v[1], F.lit(False))
            elif name == "disp":
                out &= F.array_contains("dispositions", v)
            elif name == "usable":
                out &= F.col("has_packets")
            else:
                out &= F.col({"id": "stream_id", "p": "program", "g": "group"}[name]) == v
        return out

    def select(self, streams: DataFrame) -> DataFrame:
        """The streams it matches; an index counts only those that match the other terms, within their asset."""
        found = streams.where(self.condition())
        if self.index is None:
            return found
        w = Window.partitionBy("asset_id").orderBy("stream_index")
        return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == self.index + 1).drop("_n")


def number(text: str, whole: str) -> int:
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]+", text):
        raise ValueError(f"stream specifier {whole!r}: {text!r} is no number")
    return int(text, 0) if text[:2].lower() == "0x" else int(text)


def mapped(streams: DataFrame, maps: list[str]) -> DataFrame:
    """Streams of ``[-]specifier[?]`` entries in order: a minus takes away what earlier entries gave, a question mark lets
    an entry match nothing. A stream may be mapped twice."""
    out = None
    for k, entry in enumerate(maps):
        minus, optional = entry.startswith("-"), entry.endswith("?")
        found = Specifier(entry.removeprefix("-").removesuffix("?")).select(streams)
        if minus:
            out = out.join(found.select("asset_id", "stream_index"), ["asset_id", "stream_index"], "left_anti") if out is not None else out
            continue
        if not optional and found.isEmpty():
            raise ValueError(f"{entry!r} matches no stream")
        found = found.withColumn("map", F.lit(k))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no stream is mapped")
    return out


def best_streams(streams: DataFrame, kind: str) -> DataFrame:
    """The stream of a kind that an output takes by itself, for each asset: area or channels, packets, default; the first wins ties.

    Score: area (video) or channels (audio), 100 million with packets, 5 million by default; an attached picture counts 1.
    """
    size = F.col("width") * F.col("height") if kind == "video" else F.col("channels") if kind == "audio" and "channels" in streams.columns else F.lit(0)
    score = size + F.when(F.col("has_packets"), 100_000_000).otherwise(0) + F.when(F.col("is_default"), 5_000_000).otherwise(0)
    score = F.when(F.col("attached_pic"), F.lit(1)).otherwise(score).cast("long") if kind == "video" else score.cast("long")
    scored = streams.where(F.col("kind") == kind).withColumn("score", score)
    w = Window.partitionBy("asset_id").orderBy(F.col("score").desc(), "stream_index")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_streams(streams: DataFrame) -> DataFrame:
    """The first stream of each kind of each asset."""
    return streams.groupBy("asset_id", "kind").agg(F.min("stream_index").alias("stream_index"))


class Scope:
    """A scope of metadata: ``g`` (or nothing) the file, ``s[:specifier]`` streams, ``c:N`` a chapter, ``p:N`` a program."""

    def __init__(self, text: str):
        kind, _, rest = text.partition(":")
        if kind not in ("", "g", "s", "c", "p") or (kind in ("c", "p") and not re.fullmatch(r"[0-9]+", rest)) or (kind in ("", "g") and rest):
            raise ValueError(f"metadata scope {text!r}")
        self.kind, self.rest = kind or "g", rest

    def places(self, rows: DataFrame, streams: DataFrame) -> DataFrame:
        """(asset_id, place) of what the scope names, for the assets of ``rows``; ``place`` is null for the file."""
        assets = rows.select("asset_id").distinct()
        if self.kind == "s":
            return Specifier(self.rest).select(streams).select("asset_id", F.col("stream_index").cast("long").alias("place"))
        return assets.withColumn("place", F.lit(int(self.rest) if self.rest else None).cast("long"))


#: Keys of a file that describe its making, which a copy does not take along.
OWN_KEYS = ["creation_time", "company_name", "product_name", "product_version"]


def processed(
    source: DataFrame,
    streams: DataFrame,
    maps: list[tuple[str, str]] = (),
    user: list[tuple[str, str, str]] = (),
    auto: bool = True,
    recording: bool = False,
    encoded: bool = False,
) -> DataFrame:
    """Metadata of outputs as (asset_id, scope, place, key, value) from that of their inputs, in the same form.

    First the mappings (from, to) of scopes; then, with ``auto``, the file's own entries and those of each stream, unless a
    mapping named that kind of scope on either side; of a key the first value counts. The file's entries lose ``OWN_KEYS``,
    and its duration under a recording time; streams that are encoded lose their encoder. Last the user's (scope, key, value),
    which replace, or delete by an empty value.
    """
    parts, manual = [], set()
    pick = ["asset_id", "scope", "place", "key", "value"]
    for n, (a, b) in enumerate(maps):
        src, dst = Scope(a), Scope(b)
        manual |= {src.kind, dst.kind}
        # one place to copy from, the first that the scope names
        from_ = src.places(source, streams).groupBy("asset_id").agg(F.min("place").alias("_from"))
        rows = source.where(F.col("scope") == src.kind).join(from_, "asset_id").where(F.col("place").eqNullSafe(F.col("_from"))).select("asset_id", "key", "value")
        parts.append(rows.join(dst.places(source, streams), "asset_id").select("asset_id", F.lit(dst.kind).alias("scope"), "place", "key", "value", F.lit(n).alias("_rank")))
    if auto:
        for kind, without in (("g", OWN_KEYS + (["duration"] if recording else [])), ("s", ["encoder"] if encoded else [])):
            if kind not in manual:
                rows = source.where(F.col("scope") == kind)
                parts.append((rows.where(~F.col("key").isin(without)) if without else rows).select(*pick, F.lit(len(maps)).alias("_rank")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        out = source.where("false").select(*pick, F.lit(0).alias("_rank"))
    for n, (scope, key, value) in enumerate(user):
        s = Scope(scope)
        to = s.places(source, streams)
        out = out.unionByName(to.select("asset_id", F.lit(s.kind).alias("scope"), "place", F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(-1 - n).alias("_rank")))
    first = out.groupBy("asset_id", "scope", "place", "key").agg(F.min_by(F.struct("value", "_rank"), "_rank").alias("_first"))
    # an empty value that a user gives deletes; one of the source is a value
    return first.where("_first._rank >= 0 or _first.value <> ''").select("asset_id", "scope", "place", "key", "_first.value")


def sorted_codecs(codecs: DataFrame) -> DataFrame:
    """Codecs (kind, name) with their ``place`` by kind, then name."""
    order = F.expr("CASE kind WHEN 'video' THEN 0 WHEN 'audio' THEN 1 WHEN 'data' THEN 2 WHEN 'subtitle' THEN 3 ELSE 4 END")
    own = F.row_number().over(Window.partitionBy("kind").orderBy("name"))
    return codecs.withColumn("order", order).withColumn("place", own)


def first_data(streams: DataFrame, codec: str) -> DataFrame:
    """The first data stream of each asset that has the container's data codec."""
    return streams.where((F.col("kind") == "data") & (F.col("codec") == codec)).groupBy("asset_id").agg(F.min("stream_index").alias("stream_index"))


def merged_options(by_kind: Column, by_map: Column) -> Column:
    """Options of an encoder: those of its kind of stream, and over them those of its own map."""
    return F.map_concat(F.map_filter(by_kind, lambda k, v: ~F.map_contains_key(by_map, k)), by_map)
