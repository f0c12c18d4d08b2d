"""Pixel arithmetic as column expressions: fixed-point blending and colour matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of red and blue by matrix.
LUMA = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def alpha_fixed(opacity: Column) -> Column:
    """Opacity 0 to 255 as a fixed-point factor of mask values."""
    return F.shiftright(opacity.cast("long") * 66_311 + 3, 8)


def blended(dst: Column, src: Column, mask: Column, opacity: Column) -> Column:
    """A component under a mask: weights add up to 16,843,009, 24 bits down."""
    a = mask.cast("long") * alpha_fixed(opacity)
    return F.shiftright((F.lit(16_843_009) - a) * dst.cast("long") + a * src.cast("long"), 24)


def pooled_mask(mask_sum: Column, shift_x: int, shift_y: int) -> Column:
    """Mask of a subsampled cell from the sum of its pixels' masks."""
    return F.shiftright(mask_sum, shift_x + shift_y)


def yuv(r: Column, g: Column, b: Column, matrix: str = "bt709", full: bool = False) -> tuple[Column, Column, Column]:
    """8-bit luma and chroma of an RGB colour, rounded half up."""
    kr, kb = LUMA[matrix]
    y = r * kr + g * (1 - kr - kb) + b * kb
    cb, cr = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
    ys, cs, off = (1.0, 1.0, 0) if full else (219 / 255, 224 / 255, 16)
    whole = lambda x: F.floor(x + 0.5).cast("int")
    return whole(y * ys + off), whole(cb * cs + 128), whole(cr * cs + 128)


def combined_alpha(a: Column, b: Column) -> Column:
    """Two transparencies, 0 to 255, in one."""
    return a - F.call_function("div", a * b + 127, F.lit(255)) + b


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def adjusted(v: Column, exposure: float = 0.0, brightness: float = 0.0, contrast: float = 1.0, gamma: float = 1.0) -> Column:
    """A component 0 to 1 after exposure, brightness, contrast about the middle, and gamma, within 0 to 1."""
    x = v * (2.0**exposure) + brightness
    x = (x - 0.5) * contrast + 0.5
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(1.0 / gamma))
