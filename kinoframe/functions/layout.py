"""Pixel formats, colour choices, fonts and scales as column expressions and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Pixel formats as (colour model, always full range, bytes a sample, scale in bits, components); a component
# is (plane, offset in bytes, step in bytes, shift across, shift down).
PLANAR = {
    "420": [(0, 0, 1, 0, 0), (1, 0, 1, 1, 1), (2, 0, 1, 1, 1)],
    "422": [(0, 0, 1, 0, 0), (1, 0, 1, 1, 0), (2, 0, 1, 1, 0)],
    "444": [(0, 0, 1, 0, 0), (1, 0, 1, 0, 0), (2, 0, 1, 0, 0)],
}
FORMATS = {
    "yuv420p": ("yuv", False, 1, 8, PLANAR["420"]), "yuvj420p": ("yuv", True, 1, 8, PLANAR["420"]),
    "yuv422p": ("yuv", False, 1, 8, PLANAR["422"]), "yuvj422p": ("yuv", True, 1, 8, PLANAR["422"]),
    "yuv444p": ("yuv", False, 1, 8, PLANAR["444"]), "yuvj444p": ("yuv", True, 1, 8, PLANAR["444"]),
    "nv12": ("yuv", False, 1, 8, [(0, 0, 1, 0, 0), (1, 0, 2, 1, 1), (1, 1, 2, 1, 1)]),
    "nv21": ("yuv", False, 1, 8, [(0, 0, 1, 0, 0), (1, 1, 2, 1, 1), (1, 0, 2, 1, 1)]),
    "rgb24": ("rgb", False, 1, 8, [(0, 0, 3, 0, 0), (0, 1, 3, 0, 0), (0, 2, 3, 0, 0)]),
    "bgr24": ("rgb", False, 1, 8, [(0, 2, 3, 0, 0), (0, 1, 3, 0, 0), (0, 0, 3, 0, 0)]),
    "rgba": ("rgb", False, 1, 8, [(0, 0, 4, 0, 0), (0, 1, 4, 0, 0), (0, 2, 4, 0, 0)]),
    "bgra": ("rgb", False, 1, 8, [(0, 2, 4, 0, 0), (0, 1, 4, 0, 0), (0, 0, 4, 0, 0)]),
    "argb": ("rgb", False, 1, 8, [(0, 1, 4, 0, 0), (0, 2, 4, 0, 0), (0, 3, 4, 0, 0)]),
    "abgr": ("rgb", False, 1, 8, [(0, 3, 4, 0, 0), (0, 2, 4, 0, 0), (0, 1, 4, 0, 0)]),
    "gray8": ("yuv", False, 1, 8, [(0, 0, 1, 0, 0)]),
    "yuv420p10le": ("yuv", False, 2, 10, [(p, o, 2 * s, x, y) for p, o, s, x, y in PLANAR["420"]]),
    "yuv422p10le": ("yuv", False, 2, 10, [(p, o, 2 * s, x, y) for p, o, s, x, y in PLANAR["422"]]),
    "yuv444p10le": ("yuv", False, 2, 10, [(p, o, 2 * s, x, y) for p, o, s, x, y in PLANAR["444"]]),
    "yuv420p12le": ("yuv", False, 2, 12, [(p, o, 2 * s, x, y) for p, o, s, x, y in PLANAR["420"]]),
    "p010le": ("yuv", False, 2, 16, [(0, 0, 2, 0, 0), (1, 0, 4, 1, 1), (1, 2, 4, 1, 1)]),
}
# Colour matrices that a frame's tag stands for; all others are read as bt601.
MATRIX = {"bt709": "bt709", "smpte170m": "bt601", "bt470bg": "bt601", "bt2020nc": "bt2020", "bt2020c": "bt2020", "fcc": "fcc", "smpte240m": "smpte240m", "ycgco": "ycocg"}


def formats(spark: SparkSession) -> DataFrame:
    """A row a component of each pixel format that can be drawn on."""
    rows = [(name, model, full, width, bits, i, *c) for name, (model, full, width, bits, cs) in FORMATS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "format string, model string, full_range boolean, sample_bytes int, scale_bits int, component int, plane int, offset int, step int, shift_x int, shift_y int")


def frame_bytes(format: Column, width: Column, height: Column) -> Column:
    """Bytes of a frame whose rows are packed tight, planes one after the other; null for another format.

    A plane's row has a sample group for every started cell: as many as its components' step covers.
    """
    out = F.lit(None).cast("long")
    for name, (_, _, _, _, parts) in FORMATS.items():
        total = F.lit(0).cast("long")
        for plane in sorted({p[0] for p in parts}):
            _, _, step, sx, sy = next(p for p in parts if p[0] == plane)
            total = total + F.ceil(width / (1 << sx)) * F.ceil(height / (1 << sy)) * step
        out = F.when(format == name, total).otherwise(out)
    return out


def frame_colour(frames: DataFrame) -> DataFrame:
    """Matrix and range that overlays of a stream are drawn with: those of its first frame, whatever later ones say."""
    w = Window.partitionBy("stream_index").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("space", "range")).over(w)
    table = F.create_map(*[F.lit(x) for kv in MATRIX.items() for x in kv])
    locked = frames.withColumn("_first", first)
    matrix = F.coalesce(F.try_element_at(table, F.col("_first.space")), F.lit("bt601"))
    return locked.withColumn("matrix", matrix).withColumn("drawn", F.when(F.col("_first.range") == "pc", "full").when(F.col("_first.range") == "tv", "limited")).drop("_first")


def play_scale(width: Column, height: Column, play_x: Column, play_y: Column) -> tuple[Column, Column]:
    """From a script's own resolution to a frame's, across and down."""
    return width.cast("double") / F.greatest(play_x, F.lit(1)), height.cast("double") / F.greatest(play_y, F.lit(1))


def style_distance(weight: Column, italic: Column, want_weight: Column, want_italic: Column) -> Column:
    """How far a face is from what is asked: the gap of weights, and 2000 for another slant."""
    return F.abs(weight - want_weight) + F.when(italic == want_italic, 0).otherwise(2000)


def chosen_faces(wanted: DataFrame, faces: DataFrame, default_family: str) -> DataFrame:
    """For each wanted (request, family, weight, italic) the nearest of ``faces`` (face, family, weight, italic): of its own
    family, else of the default family, else the first face of all. Names are compared without case and outer blanks."""
    plain = lambda c: F.lower(F.trim(c))
    named = faces.select("face", plain("family").alias("_family"), F.col("weight").alias("_weight"), F.col("italic").alias("_italic"))
    asked = wanted.withColumn("_try", F.explode(F.array(F.struct(F.lit(0).alias("place"), plain("family").alias("name")), F.struct(F.lit(1).alias("place"), F.lit(default_family.lower()).alias("name")))))
    near = asked.join(named, F.col("_try.name") == F.col("_family"))
    best = near.groupBy("request").agg(F.min(F.struct("_try.place", style_distance(F.col("_weight"), F.col("_italic"), F.col("weight"), F.col("italic")).alias("distance"), "face")).alias("b"))
    first = faces.agg(F.min("face")).first()[0]
    return wanted.join(best, "request", "left").select("request", F.coalesce("b.face", F.lit(first)).alias("face"))


def tight_rows(data: Column, stride: Column, row_bytes: Column, rows: Column) -> Column:
    """A plane's rows without what fills them up to ``stride`` bytes; a negative stride means the last row lies first."""
    at = lambda i: F.substr(data, (i * F.abs(stride) + 1).cast("int"), row_bytes.cast("int"))
    parts = F.transform(F.sequence(F.lit(0), (rows - 1).cast("int")), lambda i: F.hex(at(F.when(stride < 0, rows - 1 - i).otherwise(i))))
    return F.unhex(F.array_join(parts, ""))
