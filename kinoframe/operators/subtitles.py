"""Subtitle scripts: sections, styles, events, and which events are visible at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions.text import srt_ms, timecode_ms
from kinoframe.functions.values import colour, whole
from kinoframe.operators.bitstream import by_rows


#: Headers that begin a section, in any case and whatever follows them; other headers are lines of the section they are in.
SECTIONS = ("script info", "v4 styles", "v4+ styles", "events", "fonts")
# The columns of events in scripts without a format line.
EVENT_COLUMNS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
BLANK = " \t"


def script_lines(scripts: DataFrame) -> DataFrame:
    """Lines of (script_id, script) without blanks in front, with their section: the last header above them, within their
    script; ``old``: whether the last styles header is that of the older format."""
    lines = scripts.select("script_id", F.posexplode(F.split("script", "\r?\n")).alias("line_no", "line")).withColumn("line", F.ltrim("line", F.lit(BLANK)))
    header = F.lower(F.regexp_extract("line", r"(?i)^\[(" + "|".join(x.replace("+", r"\+") for x in SECTIONS) + r")\]", 1))
    header = F.when(header != "", header)
    w = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    old = F.last(F.when(header.startswith("v4"), header == "v4 styles"), ignorenulls=True).over(w)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).withColumn("old", F.coalesce(old, F.lit(False)))


def events(scripts: DataFrame) -> DataFrame:
    """``Dialogue:`` lines of the events section as (script_id, read_order, layer, start_ms, duration_ms, style, name, effect, margins,
    text), by the columns of the last ``Format:`` line above them.

    Names are in any case; the last column of a name counts; unknown columns are passed over. The text is all that is left
    where its column comes, so what the format has behind it is not there. A line with fewer values than that is no event.
    """
    rows = script_lines(scripts).where("section = 'events'")
    own = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substring("line", 8, 1 << 30), ","), lambda x: F.lower(F.trim(x, F.lit(BLANK)))))
    w = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    usual = F.array(*map(F.lit, EVENT_COLUMNS))
    usual = F.when(F.col("old"), F.concat(F.array(F.lit("marked")), F.slice(usual, 2, len(EVENT_COLUMNS)))).otherwise(usual)
    rows = rows.withColumn("_names", F.coalesce(F.last(own, ignorenulls=True).over(w), usual)).where(F.col("line").startswith("Dialogue:"))
    rows = rows.withColumn("_last", F.array_position("_names", F.lit("text")).cast("int")).where("_last > 0")
    rows = rows.withColumn("_values", F.split(F.ltrim(F.substring("line", 10, 1 << 30), F.lit(BLANK)), F.lit(","), F.col("_last"))).where("size(_values) = _last")

    def value(*names: str) -> Column:
        place = F.array_max(F.transform(F.slice("_names", F.lit(1), F.col("_last") - 1), lambda n, i: F.when(n.isin(*names), i)))
        return F.trim(F.get("_values", place), F.lit(BLANK))

    number = lambda name: F.coalesce(whole(value(name)), F.lit(0))
    start, end = (F.coalesce(timecode_ms(value(*n)), F.lit(0)) for n in (("start",), ("end", "duration")))
    order = F.row_number().over(Window.partitionBy("script_id").orderBy("line_no")) - 1
    return rows.select(
        "script_id",
        order.cast("long").alias("read_order"),
        number("layer").alias("layer"),
        start.alias("start_ms"),
        (end - start).alias("duration_ms"),
        value("style").alias("style"),
        value("name", "actor").alias("name"),
        value("effect").alias("effect"),
        *[number(f"margin{c}").alias(f"margin_{c}") for c in "lrv"],
        F.rtrim(F.get("_values", F.col("_last") - 1), F.lit(" \t\r")).alias("text"),
    )


def unpacked(text: bytes) -> tuple[bytes | None]:
    """Characters of six bits from 33 on as bytes, four for three; a rest of one is a mistake, and nothing is left."""
    if len(text) % 4 == 1:
        return (None,)
    six = (np.frombuffer(text, np.uint8) - 33) & 63
    bits = np.unpackbits(six.reshape(-1, 1), axis=1)[:, 2:].ravel()
    return (np.packbits(bits[: len(bits) // 8 * 8]).tobytes(),)


def fonts(scripts: DataFrame) -> DataFrame:
    """Files attached to scripts: (script_id, place, filename, data), without those whose data is broken."""
    rows = script_lines(scripts).where("section = 'fonts'").where(~F.lower("line").startswith("[fonts]"))
    named = F.col("line").startswith("fontname:")
    w = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.sum(named.cast("int")).over(w)).where("place > 0")
    name = F.max(F.when(named, F.ltrim(F.substring("line", 10, 1 << 30), F.lit(BLANK))))
    parts = F.array_sort(F.collect_list(F.when(~named, F.struct("line_no", "line"))))
    files = rows.groupBy("script_id", "place").agg(name.alias("filename"), F.array_join(F.transform(parts, lambda p: p["line"]), "").cast("binary").alias("coded"))
    return by_rows(files, "coded", unpacked, "data binary").where("data is not null")


def styles(scripts: DataFrame) -> DataFrame:
    """``Style:`` lines, by the section's ``Format:`` line, as (script_id, place, name, fields, colour)."""
    rows = script_lines(scripts).where(F.col("section").isin("v4+ styles", "v4 styles"))
    names = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substring("line", 8, 1 << 30), ","), lambda x: F.lower(F.trim(x))))
    w = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_names", F.last(names, ignorenulls=True).over(w)).where(F.col("line").startswith("Style:"))
    values = F.transform(F.split(F.substring("line", 7, 1 << 30), ","), lambda x: F.trim(x))
    n = F.least(F.size("_names"), F.size(values))
    fields = F.map_from_arrays(F.slice("_names", F.lit(1), n), F.slice(values, F.lit(1), n))
    out = rows.select("script_id", F.col("line_no").alias("place"), fields.alias("fields"))
    return out.select("script_id", "place", F.try_element_at("fields", F.lit("name")).alias("name"), "fields", colour(F.try_element_at("fields", F.lit("primarycolour"))).alias("colour"))


def srt_cues(scripts: DataFrame) -> DataFrame:
    """SRT cues as (script_id, read_order, start_ms, duration_ms, text)."""
    blocks = scripts.select("script_id", F.posexplode(F.split(F.regexp_replace("script", "\r", ""), "\n\n+")).alias("k", "block"))
    shape = r"([0-9]+:[0-9]{2}:[0-9]{2},[0-9]{3}) --> ([0-9]+:[0-9]{2}:[0-9]{2},[0-9]{3})[^\n]*\n([\s\S]*)$"
    start, end = (srt_ms(F.regexp_extract("block", shape, i)) for i in (1, 2))
    return blocks.where(F.col("block").rlike(shape)).select("script_id", F.col("k").cast("long").alias("read_order"), start.alias("start_ms"), (end - start).alias("duration_ms"), F.trim(F.regexp_extract("block", shape, 3)).alias("text"))


def plain_text(text):
    """Text without override blocks, hard breaks as line ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", "\n")


def first_by_order(rows: DataFrame) -> DataFrame:
    """Embedded events less repeats: of equal read orders in a script the first stays."""
    w = Window.partitionBy("script_id", "read_order").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def styled(events_: DataFrame, styles_: DataFrame) -> DataFrame:
    """Events with their style: leading asterisks are ignored, the last definition of a name counts, an unknown name takes
    ``Default``. Names are compared as they are; only that of ``Default`` may be in any case."""
    last = styles_.groupBy("script_id", F.col("name").alias("_name")).agg(F.max_by("colour", "place").alias("colour"))
    bare = F.regexp_replace("style", r"^\*+", "")
    own = events_.withColumn("_name", F.when(F.lower(bare) == "default", "Default").otherwise(bare)).join(last, ["script_id", "_name"], "left")
    fallback = last.where("_name = 'Default'").select("script_id", F.col("colour").alias("_colour"))
    return own.join(fallback, "script_id", "left").withColumn("colour", F.coalesce("colour", "_colour")).drop("_name", "_colour")


def visible(frames: DataFrame, cues: DataFrame, bin_ms: int = 5_000) -> DataFrame:
    """Frames with the events visible at their time, start <= t < start + duration, in drawing order.

    An event is put in every time bin it touches and a frame in its own, so the interval join is an equality join on
    (script, bin) whose work follows the output, not frames times events.
    """
    last = F.col("start_ms") + F.greatest(F.col("duration_ms") - 1, F.lit(0))
    cell = lambda t: F.call_function("div", t, F.lit(bin_ms))
    spread = cues.where("duration_ms > 0").withColumn("_bin", F.explode(F.sequence(cell(F.col("start_ms")), cell(last))))
    at = frames.withColumn("_bin", cell(F.col("t_ms")))
    hit = at.join(spread, ["script_id", "_bin"]).where("t_ms >= start_ms and t_ms < start_ms + duration_ms").drop("_bin")
    return hit.withColumn("z", F.row_number().over(Window.partitionBy("script_id", "t_ms").orderBy("layer", "read_order")).cast("long"))


def packets_of(cues: DataFrame, codec: str, start_us: int | None = None, duration_us: int | None = None) -> DataFrame:
    """Cues (script_id, seq, pts_us, show_ms, hide_ms, rects) as packets (script_id, seq, part, pts_us, duration_us).

    Cues before the start go, and all from the first on that reaches the end of the recording. Bitmaps for broadcast
    (``dvb``) are two packets, one that draws and one that clears; ``ass`` has one a rectangle; others one.
    """
    rows = cues if start_us is None else cues.where(F.col("pts_us") >= start_us)
    if duration_us is not None:
        late = F.max((F.col("pts_us") - (start_us or 0) >= duration_us).cast("int")).over(Window.partitionBy("script_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_late", late).where("_late = 0")
    parts = F.lit(2) if codec == "dvb" else F.greatest(F.col("rects"), F.lit(1)) if codec == "ass" else F.lit(1)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    shift = F.when(F.col("part") == 0, F.col("show_ms")).otherwise(F.col("hide_ms")) * 1000 if codec == "dvb" else F.lit(0)
    return rows.select("script_id", "seq", "part", (F.col("pts_us") + shift).alias("pts_us"), ((F.col("hide_ms") - F.col("show_ms")) * 1000).alias("duration_us"))
