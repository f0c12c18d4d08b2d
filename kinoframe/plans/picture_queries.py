"""Queries over masks, pixel formats, fonts, and the rules of composite recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from kinoframe.functions import layout, rules
from kinoframe.operators import masks, palette
from kinoframe.plans.vectors import literal, vectors
from kinoframe.scratch import cut
from kinoframe.sources.tables import PACKETS, STREAMS, packets, streams, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


# --- masks of 8 x 8 pixels: the bytes of what users say, 64 a mask ---

BYTES = """SELECT conv_id * 64 + turn AS talk, i // 64 AS part, CAST(i % 8 AS INTEGER) AS x, CAST((i // 8) % 8 AS INTEGER) AS y, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS v
        FROM (SELECT *, unnest(range(length(h) // 128 * 64)) AS i FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations WHERE role = 'user'))"""
MASK = f"SELECT talk * 4096 + part AS mask, x, y, v FROM ({BYTES})"
ACROSS, DOWN = "PARTITION BY mask, y ORDER BY x", "PARTITION BY mask, x ORDER BY y"


def mask(spark, d):
    """A mask for each 64 bytes of a text; the bytes come from pieces of a fixed size, so that nothing counts up to a text."""
    rows = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 64 + F.col("turn")).alias("talk"), F.hex(F.col("text").cast("binary")).alias("h"))
    parts = rows.select("talk", F.posexplode(F.regexp_extract_all("h", F.lit("[0-9A-F]{128}"), 0)).alias("part", "piece"))
    pixels = parts.select((F.col("talk") * 4096 + F.col("part")).alias("mask"), F.posexplode(F.regexp_extract_all("piece", F.lit(".."), 0)).alias("i", "b"))
    return pixels.select("mask", (F.col("i") % 8).alias("x"), F.call_function("div", F.col("i"), F.lit(8)).cast("int").alias("y"), F.conv("b", 16, 10).cast("int").alias("v"))


@query("mask_union", f"SELECT mask, x, y, max(v) AS v FROM (SELECT * FROM ({MASK}) UNION ALL SELECT mask + 1, x, y, 255 - v FROM ({MASK})) GROUP BY 1, 2, 3")
def _(spark, d):
    return masks.united(mask(spark, d), mask(spark, d).withColumn("mask", F.col("mask") + 1).withColumn("v", 255 - F.col("v")))


@query("mask_clip", f"SELECT mask, x, y, CASE WHEN x >= 2 AND x < 6 AND y >= -3 AND y < 5 THEN v ELSE 0 END AS v, CASE WHEN x >= 2 AND x < 6 AND y >= -3 AND y < 5 THEN 0 ELSE v END AS rest FROM ({MASK})")
def _(spark, d):
    inside = masks.clipped(mask(spark, d).withColumn("whole", F.col("v")), 2, -3, 6, 5)
    outside = masks.clipped(inside.withColumn("kept", F.col("v")).withColumn("v", F.col("whole")), 2, -3, 6, 5, inverse=True)
    return outside.select("mask", "x", "y", F.col("kept").alias("v"), F.col("v").alias("rest"))


def roomy(across: int, down: int) -> str:
    """Masks with empty pixels around them."""
    return f"""SELECT g.mask, g.x, g.y, coalesce(m.v, 0) AS v FROM (SELECT mask, x, CAST(unnest(range(y0 - {down}, y1 + {down} + 1)) AS INTEGER) AS y FROM (
        SELECT mask, y0, y1, CAST(unnest(range(x0 - {across}, x1 + {across} + 1)) AS INTEGER) AS x FROM (SELECT mask, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({MASK}) GROUP BY 1))) g
        LEFT JOIN ({MASK}) m ON g.mask = m.mask AND g.x = m.x AND g.y = m.y"""


def blurred(rows: str) -> str:
    for w in (ACROSS, DOWN):
        rows = f"SELECT mask, x, y, coalesce(lag(v) OVER ({w}), v) + 2 * v + coalesce(lead(v) OVER ({w}), v) AS v FROM ({rows})"
    return f"SELECT mask, x, y, v >> 4 AS v FROM ({rows})"


@query("edge_blur", blurred(roomy(1, 1)))
def _(spark, d):
    return masks.edge_blurred(mask(spark, d), 1)


DEEP = f"SELECT mask, x, y, ((v >> 1) + 1) >> 1 AS v FROM ({roomy(3, 3)})"


@query("edge_blur_thrice", blurred(f"SELECT mask, x, y, (v * 4 - CASE WHEN v > 32 THEN 1 ELSE 0 END) & 255 AS v FROM ({blurred(blurred(DEEP))})"))
def _(spark, d):
    return masks.edge_blurred(mask(spark, d), 3)


def boxed(rows: str, radii: list[tuple[int, int]]) -> str:
    for pair in radii:
        for r, w in zip(pair, (ACROSS, DOWN)):
            if r:
                rows = f"SELECT mask, x, y, sum(v) OVER ({w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) // {2 * r + 1} AS v FROM ({rows})"
    return f"SELECT mask, x, y, CAST(v AS INTEGER) AS v FROM ({rows})"


# by hand: boxes of 3, 5 and 5 pixels for a spread of 2.3, and of 3, 3 and 3 for one of 1.5
@query("gaussian_blur", boxed(roomy(8, 6), [(1, 1), (2, 1), (2, 1)]))
def _(spark, d):
    return masks.gaussian_blurred(mask(spark, d), 2.3, 1.5)


@query("visible_overlays", f"SELECT asset_id, stream_index, stream_index % 5 <> 0 AND width - 400 < 320 AND height - 300 < 240 AND width - 400 + 100 > 0 AND height - 300 + 80 > 0 AS seen FROM ({STREAMS})")
def _(spark, d):
    n = F.lit
    return streams(spark, d).select("asset_id", "stream_index", masks.is_seen(F.col("stream_index") % 5, F.col("width") - 400, F.col("height") - 300, n(100), n(80), n(320), n(240)).alias("seen"))


# --- palettes: three bytes of what is said are a pixel, a conversation is a clip ---


def coloured(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), "turn", F.explode(F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("[0-9A-F]{6}"), 0)).alias("p"))
    return rows.select("clip", *[F.conv(F.substring("p", i, 2), 16, 10).cast("int").alias(c) for i, c in ((1, "r"), (3, "g"), (5, "b"))])


def clip_palette(spark, d):
    """The 16 colours of every conversation, and how many of its pixels are nearest to each; the cut is no SQL, see tests/test_palette.py."""
    pixels = coloured(spark, d)
    counted = cut(palette.cells(pixels))
    entries = cut(palette.palettes(counted, 16))
    used = palette.mapped(pixels, counted, entries).groupBy("clip", "entry").agg(F.count(F.lit(1)).alias("pixels"))
    return entries.join(used, ["clip", "entry"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))


QUERIES["clip_palette"] = clip_palette


# --- formats, colours, fonts ---


#: Formats with their model, planes, bits, and shifts of chroma.
LAYOUTS = """('yuv420p', 'yuv', 3, 8, 1, 1), ('yuvj420p', 'yuv', 3, 8, 1, 1), ('yuv422p', 'yuv', 3, 8, 1, 0), ('yuvj422p', 'yuv', 3, 8, 1, 0), ('yuv444p', 'yuv', 3, 8, 0, 0), ('yuvj444p', 'yuv', 3, 8, 0, 0),
        ('nv12', 'yuv', 2, 8, 1, 1), ('nv21', 'yuv', 2, 8, 1, 1), ('rgb24', 'rgb', 1, 8, 0, 0), ('bgr24', 'rgb', 1, 8, 0, 0), ('rgba', 'rgb', 1, 8, 0, 0), ('bgra', 'rgb', 1, 8, 0, 0), ('argb', 'rgb', 1, 8, 0, 0), ('abgr', 'rgb', 1, 8, 0, 0),
        ('gray8', 'yuv', 1, 8, 0, 0), ('yuv420p10le', 'yuv', 3, 10, 1, 1), ('yuv422p10le', 'yuv', 3, 10, 1, 0), ('yuv444p10le', 'yuv', 3, 10, 0, 0), ('yuv420p12le', 'yuv', 3, 12, 1, 1), ('p010le', 'yuv', 2, 16, 1, 1)"""


@query(
    "pixel_formats",
    f"""WITH v(format, model, planes, bits, shift_x, shift_y) AS (VALUES {LAYOUTS}), f AS (SELECT *, row_number() OVER (ORDER BY format) - 1 AS place FROM v)
        SELECT stream_index, format, model, planes, bits, shift_x, shift_y FROM ({STREAMS}) s JOIN f ON f.place = s.stream_index % 20""",
)
def _(spark, d):
    every = layout.formats(spark).groupBy("format", "model").agg((F.max("plane") + 1).alias("planes"), F.max("scale_bits").alias("bits"), F.max("shift_x").alias("shift_x"), F.max("shift_y").alias("shift_y"))
    every = every.withColumn("place", F.row_number().over(Window.orderBy("format")) - 1)  # some twenty rows
    return streams(spark, d).withColumn("place", F.col("stream_index") % 20).join(every, "place").select("stream_index", "format", "model", "planes", "bits", "shift_x", "shift_y")


KINDS = ["yuv420p", "nv12", "rgb24", "yuv422p10le", "p010le", "other"]


@query(
    "frame_bytes",
    f"""SELECT stream_index, CAST(CASE stream_index % 6 WHEN 0 THEN w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2) WHEN 1 THEN w * h + ((w + 1) // 2) * ((h + 1) // 2) * 2 WHEN 2 THEN 3 * w * h
        WHEN 3 THEN 2 * w * h + 4 * ((w + 1) // 2) * h WHEN 4 THEN 2 * w * h + 4 * ((w + 1) // 2) * ((h + 1) // 2) END AS BIGINT) AS bytes FROM (SELECT stream_index, width + stream_index % 3 AS w, height AS h FROM ({STREAMS}))""",
)
def _(spark, d):
    k = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("stream_index") % 6 + 1).cast("int"))
    return streams(spark, d).select("stream_index", layout.frame_bytes(k, F.col("width") + F.col("stream_index") % 3, F.col("height")).alias("bytes"))


SPACES = ["bt709", "smpte170m", "bt470bg", "bt2020c", "unspecified", "fcc", "ycgco", None]
MATRICES = ["bt709", "bt601", "bt601", "bt2020", "bt601", "fcc", "ycocg", "bt601"]


@query(
    "frame_colour",
    f"""SELECT p.stream_index, p.seq, ({literal(MATRICES)})[f.first % 8 + 1] AS matrix, ({literal(["full", "limited", None])})[f.first % 3 + 1] AS drawn
        FROM ({PACKETS}) p JOIN (SELECT stream_index, min(seq) AS first FROM ({PACKETS}) GROUP BY 1) f USING (stream_index)""",
)
def _(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("seq") % n + 1).cast("int"))
    rows = packets(spark, d).select("stream_index", "seq", pick(SPACES, 8).alias("space"), pick(["pc", "tv", "unspecified"], 3).alias("range"))
    return layout.frame_colour(rows).select("stream_index", "seq", "matrix", "drawn")


@query("play_scale", f"SELECT stream_index, width / greatest(stream_index % 4 * 96, 1)::DOUBLE AS x, height / greatest(stream_index % 3 * 72, 1)::DOUBLE AS y FROM ({STREAMS})")
def _(spark, d):
    x, y = layout.play_scale(F.col("width"), F.col("height"), F.col("stream_index") % 4 * 96, F.col("stream_index") % 3 * 72)
    return streams(spark, d).select("stream_index", x.alias("x"), y.alias("y"))


FACES = [(0, "Serif", 400, False), (1, "Serif", 700, False), (2, "serif", 400, True), (3, "Sans", 400, False), (4, "Sans", 900, False)]


@query(
    "font_faces",
    f"""WITH f(face, family, weight, italic) AS (VALUES {", ".join(f"({i}, '{n}', {w}, {str(t).lower()})" for i, n, w, t in FACES)}),
        w AS (SELECT stream_index AS request, CASE stream_index % 3 WHEN 0 THEN 'serif' WHEN 1 THEN 'sans' ELSE 'missing' END AS family, stream_index % 10 * 100 AS weight, stream_index % 2 = 0 AS italic FROM ({STREAMS}))
        SELECT request, arg_min(face, (CASE WHEN lower(f.family) = w.family THEN 0 ELSE 1 END, abs(f.weight - w.weight) + CASE WHEN f.italic = w.italic THEN 0 ELSE 2000 END, face)) AS face
        FROM w JOIN f ON lower(f.family) = w.family OR lower(f.family) = 'sans' GROUP BY 1""",
)
def _(spark, d):
    k = F.col("stream_index")
    wanted = streams(spark, d).select(k.alias("request"), F.when(k % 3 == 0, " Serif ").when(k % 3 == 1, "SANS").otherwise("missing").alias("family"), (k % 10 * 100).alias("weight"), (k % 2 == 0).alias("italic"))
    return layout.chosen_faces(wanted, spark.createDataFrame(FACES, "face int, family string, weight int, italic boolean"), "Sans")


@query("tight_rows", f"SELECT seq, CASE WHEN seq % 2 = 0 THEN 'ABCEFG' ELSE 'EFGABC' END AS rows FROM ({PACKETS})")
def _(spark, d):
    stride = F.when(F.col("seq") % 2 == 0, 4).otherwise(-4)
    return packets(spark, d).select("seq", layout.tight_rows(F.lit(b"ABC.EFG."), stride, F.lit(3), F.lit(2)).cast("string").alias("rows"))


# --- rules of recipes ---

LINE = "SELECT *, CAST(l_quantity AS INTEGER) AS q, CAST(l_linenumber AS INTEGER) AS n, CAST(l_partkey AS BIGINT) AS k FROM lineitem"


def ruled(name: str, sql: str, rule: Callable[[Column, Column, Column], Column]) -> None:
    """A query ``name``: a rule over the quantity, number and part of every line of an order."""

    @query(name, f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM ({LINE})")
    def _(spark, d):
        rows = table(spark, d, "lineitem").withColumns({"q": F.col("l_quantity").cast("int"), "n": F.col("l_linenumber").cast("int"), "k": F.col("l_partkey")})
        return rows.select("l_orderkey", "l_linenumber", rule(F.col("q"), F.col("n"), F.col("k")).alias("v"))


ruled(
    "scale_clauses",
    "CASE WHEN (q % 3 = 0 AND q % 4 = 0) OR (q % 4 <> 0 AND n = 1) THEN NULL ELSE 'scale=' || CASE WHEN q % 3 = 0 THEN '-2' ELSE (q * 16)::VARCHAR END || ':' || CASE WHEN q % 4 = 0 THEN '-2' ELSE ((n - 1) * 90)::VARCHAR END END",
    lambda q, n, k: rules.scale_clause(F.when(q % 3 != 0, q * 16), F.when(q % 4 != 0, (n - 1) * 90)),
)
ruled("sprite_grids", "n > 1 AND k > 0 AND q * k <= 65535 AND (n - 1) * (k * 7) <= 65535", lambda q, n, k: rules.is_grid(q, n - 1, k, k * 7))
ruled(
    "gif_clauses",
    """'[0:v]fps=' || q || CASE WHEN q % 2 = 0 THEN ',scale=' || k || ':-1:flags=lanczos' ELSE '' END || ',split[a][b];[a]palettegen' || CASE WHEN q % 3 = 0 THEN '=max_colors=' || n * 32 ELSE '' END
        || '[p];[b][p]paletteuse=dither=' || CASE l_returnflag WHEN 'A' THEN 'bayer:bayer_scale=' || (n - 1) WHEN 'N' THEN 'sierra2_4a' ELSE 'none' END || '[v]'""",
    lambda q, n, k: rules.gif_clause(q, F.when(q % 2 == 0, k), F.when(q % 3 == 0, n * 32), F.when(F.col("l_returnflag") == "A", "bayer").when(F.col("l_returnflag") == "N", "sierra2_4a").otherwise("none"), n - 1),
)
ruled("gif_loops", "CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '-1' ELSE q::VARCHAR END", lambda q, n, k: rules.loop_value(F.when(F.col("l_returnflag") == "A", "infinite").when(F.col("l_returnflag") == "N", "once").otherwise("count"), q))
ruled(
    "ladder_rates",
    "CASE WHEN q % 3 = 0 THEN CASE WHEN n > 2 AND k % 5 > 0 THEN (n - 2) || '/' || (k % 5) END WHEN q > 5 AND n > 1 THEN (q - 5) * 1000 || '/' || (n - 1) END",
    lambda q, n, k: (lambda r: F.concat(r["num"].cast("string"), F.lit("/"), r["den"].cast("string")))(rules.resolved_rate(F.when(q % 3 != 0, (q - 5) * 1_000), n - 1, n - 2, k % 5)),
)
ruled("black_detectors", "l_tax - 0.02::DOUBLE >= 0 AND l_discount * 11 <= 1 AND l_tax * 14 <= 1", lambda q, n, k: rules.is_black_detector(F.col("l_tax") - 0.02, F.col("l_discount") * 11, F.col("l_tax") * 14))
ruled("scene_detectors", "q * 3 - 20 >= 0 AND q * 3 - 20 <= 100", lambda q, n, k: rules.is_scene_detector((q * 3 - 20).cast("double")))
ruled("crop_detectors", "k * 4000000 <= 2147483647 AND n > 1 AND q::BIGINT * 60000000 <= 2147483647", lambda q, n, k: rules.is_crop_detector(k * 4_000_000, (n - 2).cast("long"), q.cast("long") * 60_000_000))
ruled(
    "autorotation",
    """CASE t WHEN 0 THEN '' WHEN 90 THEN 'transpose=clock' WHEN 180 THEN 'hflip,vflip' WHEN 270 THEN 'transpose=cclock' ELSE 'rotate=' || t || '*PI/180' END || ':' || CASE WHEN t IN (90, 270) THEN k || 'x' || q ELSE q || 'x' || k END""".replace("CASE t", "CASE ((n * 45 - 180 + 360) % 360)").replace("WHEN t IN", "WHEN ((n * 45 - 180 + 360) % 360) IN").replace("|| t ||", "|| ((n * 45 - 180 + 360) % 360) ||"),
    lambda q, n, k: (lambda t: F.concat(t["step"], F.lit(":"), t["width"].cast("string"), F.lit("x"), t["height"].cast("string")))(rules.turned((n * 45 - 180).cast("double"), q.cast("long"), k)),
)
vectors(query, "containers", "VARCHAR", [
    ("464c5601", "flv"), ("52494646000000005741564566", "wav"), ("664c6143", "flac"), ("494433", "mp3"), ("4f676753", "ogg"), ("1a45dfa3", "matroska,webm"), ("000000186674797069736f6d", "mov,mp4,m4a,3gp,3g2,mj2"),
    ("fff150", "aac"), ("efbbbf5b53637269707420496e666f5d", "ass"), ("310a30303a30303a30312c303030", "srt"), ("52494646000000004156492c", None), ("00", None), ("", None),
], lambda c: rules.signature_of(F.unhex(c)))
