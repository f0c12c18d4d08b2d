"""Arguments of composite recipes: what is allowed, and the texts they become."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest width or height of a picture.
MOST_SIDE = 65_535


def scale_clause(width: Column, height: Column) -> Column:
    """A scale step; a side that is missing follows the other, rounded to even. Null without a side, or with one of 0."""
    side = lambda c: F.coalesce(c.cast("string"), F.lit("-2"))
    bad = (width.isNull() & height.isNull()) | F.coalesce(width < 1, F.lit(False)) | F.coalesce(height < 1, F.lit(False))
    return F.when(~bad, F.concat(F.lit("scale="), side(width), F.lit(":"), side(height)))


def is_grid(cols: Column, rows: Column, cell_w: Column, cell_h: Column) -> Column:
    """Whether a sprite sheet of that grid can be made."""
    some = (cols > 0) & (rows > 0) & (cell_w > 0) & (cell_h > 0)
    return some & (cols.cast("long") * cell_w <= MOST_SIDE) & (rows.cast("long") * cell_h <= MOST_SIDE)


def gif_clause(fps: Column, width: Column, colours: Column, dither: Column, bayer: Column) -> Column:
    """The steps of an animated GIF: rate, scale, and a palette of its own. The text and its labels."""
    return F.concat(
        F.lit("[0:v]fps="), fps.cast("string"),
        F.coalesce(F.concat(F.lit(",scale="), width.cast("string"), F.lit(":-1:flags=lanczos")), F.lit("")),
        F.lit(",split[a][b];[a]palettegen"),
        F.coalesce(F.concat(F.lit("=max_colors="), colours.cast("string")), F.lit("")),
        F.lit("[p];[b][p]paletteuse=dither="), dither,
        F.when(dither == "bayer", F.concat(F.lit(":bayer_scale="), bayer.cast("string"))).otherwise(""),
        F.lit("[v]"),
    )


def loop_value(kind: Column, count: Column) -> Column:
    """How often a GIF plays: 0 for ever, -1 once, else the count."""
    return F.when(kind == "infinite", "0").when(kind == "once", "-1").otherwise(count.cast("string"))


def resolved_rate(forced_num: Column, forced_den: Column, num: Column, den: Column) -> Column:
    """Frame rate of a ladder: the one that is forced, else the stream's; null where that is no constant rate."""
    own = F.when((num > 0) & (den > 0), F.struct(num.cast("long").alias("num"), den.cast("long").alias("den")))
    forced = F.when((forced_num > 0) & (forced_den > 0), F.struct(forced_num.cast("long").alias("num"), forced_den.cast("long").alias("den")))
    return F.when(forced_num.isNotNull(), forced).otherwise(own)


def is_black_detector(least_s: Column, pixel: Column, picture: Column) -> Column:
    share = lambda c: ~F.isnan(c) & (c >= 0) & (c <= 1)
    return ~F.isnan(least_s) & (least_s >= 0) & (least_s < float("inf")) & share(pixel) & share(picture)


def is_scene_detector(percent: Column) -> Column:
    return ~F.isnan(percent) & (percent >= 0) & (percent <= 100)


def is_crop_detector(limit: Column, round_: Column, reset: Column) -> Column:
    top = (1 << 31) - 1
    return (limit.between(0, top)) & (round_.between(0, top)) & (reset.between(0, top))


def turned(degrees: Column, width: Column, height: Column) -> Column:
    """What a display rotation, in degrees clockwise, becomes: the step that undoes it, and the picture's size after it."""
    d = F.pmod(F.round(degrees), F.lit(360)).cast("int")
    step = F.when(d == 90, "transpose=clock").when(d == 180, "hflip,vflip").when(d == 270, "transpose=cclock").when(d == 0, "").otherwise(F.concat(F.lit("rotate="), d.cast("string"), F.lit("*PI/180")))
    side = d.isin(90, 270)
    return F.struct(step.alias("step"), F.when(side, height).otherwise(width).alias("width"), F.when(side, width).otherwise(height).alias("height"))


def signature_of(head: Column) -> Column:
    """Short name of a container by its first bytes, for files without an ending; null for one that is not known."""
    begins = lambda *b: F.substring(head, 1, len(b)) == F.lit(bytes(b))
    text = F.decode(F.substring(head, 1, 64), "ISO-8859-1")
    return (
        F.when(begins(*b"FLV\x01"), "flv").when(begins(*b"RIFF") & (F.substring(head, 9, 4) == F.lit(b"WAVE")), "wav").when(begins(*b"fLaC"), "flac").when(begins(*b"ID3") | begins(0xFF, 0xFB), "mp3")
        .when(begins(*b"OggS"), "ogg").when(begins(0x1A, 0x45, 0xDF, 0xA3), "matroska,webm").when(F.substring(head, 5, 4) == F.lit(b"ftyp"), "mov,mp4,m4a,3gp,3g2,mj2").when(begins(0x47), "mpegts")
        .when(begins(0xFF, 0xF1) | begins(0xFF, 0xF9), "aac").when(text.rlike(r"^(\xEF\xBB\xBF)?\[Script Info\]"), "ass").when(text.rlike(r"^(\xEF\xBB\xBF)?[0-9]+\r?\n[0-9]+:[0-9]{2}:[0-9]{2},"), "srt").when(begins(*b"GIF8"), "gif")
    )
