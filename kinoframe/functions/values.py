"""Scalar values of subtitle scripts as column expressions.

The grammars read a prefix: what comes after a value is left, what cannot be read is 0. Whole numbers of scripts wrap at
2^32, those of override tags saturate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = 1 << 32

# Names of colour matrices in a script's header.
MATRICES = {
    "none": "none",
    "tv.601": "bt601-tv", "pc.601": "bt601-pc", "tv.709": "bt709-tv", "pc.709": "bt709-pc",
    "tv.240m": "smpte240m-tv", "pc.240m": "smpte240m-pc", "tv.fcc": "fcc-tv", "pc.fcc": "fcc-pc",
}


def wrapped(text: Column) -> Column:
    """A whole number modulo 2^32 as an unsigned long: hexadecimal after ``&H`` or ``0x``, else decimal."""
    hexadecimal = text.rlike("(?i)^(&h|0x)")
    shape16, shape10 = r"(?i)^(?:&h|0x)[ \t]*([+-]?)(?:0x)?([0-9a-f]*)", r"^[ \t]*([+-]?)([0-9]*)"
    digits16 = F.regexp_extract(text, shape16, 2)
    size16 = F.coalesce(F.conv(F.right(digits16, F.lit(8)), 16, 10).try_cast("long"), F.lit(0))
    # 10^32 is a multiple of 2^32, so the last 32 digits decide
    size10 = F.coalesce((F.right(F.regexp_extract(text, shape10, 2), F.lit(32)).try_cast("decimal(38,0)") % F.lit(WRAP)).cast("long"), F.lit(0))
    size = F.when(hexadecimal, size16).otherwise(size10)
    minus = F.when(hexadecimal, F.regexp_extract(text, shape16, 1)).otherwise(F.regexp_extract(text, shape10, 1)) == "-"
    return F.when(minus, F.pmod(-size, F.lit(WRAP))).otherwise(size)


def whole(text: Column) -> Column:
    """The same as a signed 32-bit number."""
    v = wrapped(text)
    return F.when(v >= WRAP // 2, v - WRAP).otherwise(v).cast("int")


def saturated(text: Column) -> Column:
    """A hexadecimal number of an override tag, after any ``&`` and ``H``, held within 32 bits."""
    bare = F.regexp_replace(text, "^[&H]+", "")
    shape = r"^\s*([+-]?)(?:0[xX](?=[0-9a-fA-F]))?0*([0-9a-fA-F]*)"
    digits = F.regexp_extract(bare, shape, 2)
    size = F.when(F.length(digits) > 8, WRAP).otherwise(F.coalesce(F.conv(digits, 16, 10).try_cast("long"), F.lit(0)))
    minus = F.regexp_extract(bare, shape, 1) == "-"
    return F.when(minus, F.greatest(-size, F.lit(-WRAP // 2))).otherwise(F.least(size, F.lit(WRAP // 2 - 1))).cast("int")


def leading_whole(text: Column) -> Column:
    """A decimal number in front as a long, held within 64 bits; 0 without digits."""
    sign, digits = (F.regexp_extract(text, r"^\s*([+-]?)0*([0-9]*)", i) for i in (1, 2))
    n = F.when(F.length(digits) > 19, F.lit("9" * 19)).otherwise(digits).try_cast("decimal(38,0)")
    n = F.coalesce(F.when(sign == "-", -n).otherwise(n), F.lit(0))
    top = (1 << 63) - 1
    return F.when(n > top, top).when(n < -top - 1, -top - 1).otherwise(n).cast("long")


def decimal_prefix(text: Column) -> Column:
    """A decimal number in front: its value and how many characters it takes; null without a digit. An exponent mark is
    taken even where no digits follow it."""
    shape = r"^(\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([eE][+-]?[0-9]*)?)"
    power = F.regexp_extract(text, shape, 3)
    number = F.concat(F.regexp_extract(text, shape, 2), F.when(power.rlike("[0-9]$"), power).otherwise(""))
    return F.when(text.rlike(shape), F.struct(number.try_cast("double").alias("value"), F.length(F.regexp_extract(text, shape, 1)).alias("end")))


def decimal(text: Column) -> Column:
    return F.coalesce(decimal_prefix(text)["value"], F.lit(0.0))


def colour_of(packed: Column) -> Column:
    """A number whose bytes are transparency, blue, green, red, as a struct."""
    byte = lambda n: F.shiftright(packed.cast("long"), n).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(byte(0).alias("r"), byte(8).alias("g"), byte(16).alias("b"), byte(24).alias("t"))


def colour(text: Column) -> Column:
    """A style's colour, ``&HAABBGGRR`` or the same number in decimal."""
    return colour_of(wrapped(text))


def colour_tag(text: Column) -> Column:
    """An override tag's colour, always hexadecimal."""
    return colour_of(saturated(text))


def is_yes(text: Column) -> Column:
    """True for what begins with ``yes`` in any case, or with a whole number above 0; blanks in front do not count."""
    bare = F.regexp_replace(text, r"^[ \t]+", "")
    return bare.rlike("(?i)^yes") | bare.rlike(r"^\s*\+?0*[1-9]")


def matrix(text: Column) -> Column:
    """A script's colour matrix; ``default`` where it says nothing, ``unknown`` for another name."""
    name = F.lower(F.regexp_replace(text, r"^[ \t]+|[ \t]+$", ""))
    table = F.create_map(*[F.lit(x) for kv in MATRICES.items() for x in kv])
    return F.when(name == "", "default").otherwise(F.coalesce(F.try_element_at(table, name), F.lit("unknown")))


def keypad_alignment(n: Column) -> Column:
    """Keypad position as the older code: column 1 to 3, plus 8 in the middle row or 4 in the top row.

    A negative counts as its size, everything above 6 is the top row, 0 is 0, and the least number is 2.
    """
    size = F.when(n == -(1 << 31), 2).otherwise(F.abs(n)).cast("long")
    return ((size - 1) % 3 + 1 + F.when(size <= 3, 0).when(size <= 6, 8).otherwise(4)).cast("int")
