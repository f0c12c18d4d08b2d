"""Exact rational-timestamp algebra as column expressions.

Products of two 64-bit numbers need 128 bits; decimals of 38 digits hold them where magnitudes allow, and a comparison
never divides. ``sign`` and doubles are avoided, as they lose bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def rescale_q(ts: Column, from_num: int, from_den: int, to_num: int, to_den: int) -> Column:
    """``ts`` ticks of from_num/from_den in ticks of to_num/to_den, halves away from zero; null stays null."""
    n, d = from_num * to_den, from_den * to_num
    return rescale(ts, F.lit(n), F.lit(d))


def rescale(ts: Column, n: Column, d: Column) -> Column:
    """``ts * n / d`` with halves away from zero for positive ``n`` and ``d``."""
    size = wide(F.abs(ts)) * wide(n) * 2 + wide(d)
    whole = F.call_function("div", size, wide(d) * 2)
    return F.when(ts < 0, -whole).otherwise(whole)


def pts_to_us(pts: Column, num: int, den: int) -> Column:
    """Ticks in microseconds."""
    return rescale_q(pts, num, den, 1, MICROS)


def secs_to_us(x: Column) -> Column:
    """Seconds in microseconds, rounded half away from zero; null for what is not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x * MICROS).cast("long"))


def compare_ts(a: Column, a_num: int, a_den: int, b: Column, b_num: int, b_den: int) -> Column:
    """-1, 0 or 1: which of two stamps of different time bases is earlier, exactly."""
    left, right = wide(a) * (a_num * b_den), wide(b) * (b_num * a_den)
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def scaled_ts(ts: Column, scale: float) -> Column:
    """A stamp times a double, cut toward zero."""
    return (ts * F.lit(float(scale))).cast("long")


def percent_to_us(percent: float, duration: Column) -> Column:
    return (duration * F.lit(float(percent)) / 100).cast("long")


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a + b - 1, b)
