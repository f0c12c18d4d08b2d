"""Side data of packets: entries and announced changes of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.operators.bitstream import byte_at

# What an announcement says has changed.
RATE, DIMENSIONS = 4, 8


def entries(packets: DataFrame, column: str = "side_data") -> DataFrame:
    """A row an entry of array<struct<type, size, data>>, with its number ``entry_no`` and ``problem``.

    An entry of size 0 is empty, whatever it points to; one with a size and no data is broken.
    """
    rest = [c for c in packets.columns if c != column]
    one = packets.select(*rest, F.posexplode(column).alias("entry_no", "_e"))
    broken = (F.col("_e.size") > 0) & F.col("_e.data").isNull()
    data = F.when(F.col("_e.size") == 0, F.lit(b"")).otherwise(F.col("_e.data"))
    return one.select(*rest, "entry_no", F.col("_e.type").alias("type"), data.alias("data"), F.when(broken, "no payload").alias("problem"))


def little_endian(data: Column, at: Column | int) -> Column:
    """The four bytes from ``at`` (from 0) on as a signed number, lowest first; null past the end."""
    byte = lambda i: F.conv(F.hex(F.substring(data, F.lit(at) + 1 + i, F.lit(1))), 16, 10).cast("long")
    n = byte(0) + byte(1) * (1 << 8) + byte(2) * (1 << 16) + byte(3) * (1 << 24)
    n = F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)
    return F.when(F.octet_length(data) >= F.lit(at) + 4, n)


def parameter_change(data: Column, sample_rate: Column, width: Column, height: Column) -> Column:
    """What is wrong with an announcement for a stream of these parameters, null if it changes nothing.

    Flags, then the fields they select: the rate, then width and height. The payload must be exactly that long, values in
    the range that decoders take, and equal to the stream's.
    """
    flags = F.when(F.octet_length(data) >= 4, byte_at(data, 0))
    others = F.coalesce(F.substring(data, 2, 3) != F.lit(bytes(3)), F.lit(False)) | (flags.bitwiseAND(F.lit(255 - RATE - DIMENSIONS)) != 0)
    has_rate, has_size = flags.bitwiseAND(F.lit(RATE)) != 0, flags.bitwiseAND(F.lit(DIMENSIONS)) != 0
    length = 4 + F.when(has_rate, 4).otherwise(0) + F.when(has_size, 8).otherwise(0)
    rate, at = little_endian(data, 4), F.when(has_rate, 8).otherwise(4)
    w, h = little_endian(data, at), little_endian(data, at + 4)
    fits = (w > 0) & (h > 0) & ((w + 128) * (h + 128) < ((1 << 31) - 1) // 8)
    return (
        F.when(flags.isNull(), "cut off")
        .when(others, "unknown flags")
        .when(F.octet_length(data) != length, "wrong length")
        .when(has_rate & (rate <= 0), "rate out of range")
        .when(has_rate & (rate != sample_rate), "rate changed")
        .when(has_size & ~fits, "dimensions out of range")
        .when(has_size & ((w != width) | (h != height)), "dimensions changed")
    )
