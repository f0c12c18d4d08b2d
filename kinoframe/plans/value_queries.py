"""Queries over the grammars of scalar values: numbers of a table, written in the notations of each grammar and read again.

The SQL knows the numbers and never sees a text. Odd inputs with stated results are in ``tests/test_values.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinoframe.functions import text, values
from kinoframe.sources.tables import table

QUERIES, ORACLE = {}, {}

#: Lines of orders as whole numbers: k, q (1 to 50), c (hundredths).
NUMBERS = "SELECT *, CAST(l_partkey AS BIGINT) AS k, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem"


def numbers(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.withColumns({"k": F.col("l_partkey"), "q": F.col("l_quantity").cast("int"), "c": F.round(F.col("l_extendedprice") * 100).cast("long")})


def written(name: str, sql: str, wording: Callable[[Column, Column], Column], reads: Callable[[Column], Column]) -> None:
    """A query ``name``: what the operator ``reads`` in the ``wording`` of a line's numbers, by SQL over the numbers themselves."""
    ORACLE[name] = f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM ({NUMBERS})"

    def run(spark, d):
        return numbers(spark, d).withColumn("x", wording(F.col("k"), F.col("c"))).select("l_orderkey", "l_linenumber", reads(F.col("x")).alias("v"))

    QUERIES[name] = run


def one_of(*cases: Column) -> Column:
    """The case that the quantity picks."""
    out = F.lit(None)
    for i, c in reversed(list(enumerate(cases))):
        out = F.when(F.col("q") % len(cases) == i, c).otherwise(out)
    return out


def word(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def packed(c):
    return F.concat_ws(",", *[c[k].cast("string") for k in "rgbt"])


def digits(n: Column, size: int) -> Column:
    return F.lpad(n.cast("string"), size, "0")


shade = lambda k, c: (k * 65_537 + c) % (1 << 31)
SHADE = "((k * 65537 + c) % 2147483648)"
BYTES = ", ".join(f"(({SHADE} >> {n}) & 255)" for n in (0, 8, 16, 24))
part = lambda n, m: F.call_function("div", n, F.lit(m))
whole = lambda n: n.cast("string")

written("script_int", "CAST(CASE q % 4 WHEN 2 THEN -k ELSE k END AS INTEGER)", lambda k, c: one_of(word(" \t", whole(k)), word("&H", F.hex(k)), word("-", whole(k), "abc"), word("0x", F.hex(k), "&")), values.whole)
written("script_bool", "CASE q % 4 WHEN 0 THEN true WHEN 1 THEN k > 0 ELSE false END", lambda k, c: one_of(word(" yEs", F.col("l_returnflag")), word("0", whole(k), "x"), word("no", whole(k)), word("-", whole(k))), values.is_yes)
written("packed_colours", f"concat_ws(',', {BYTES})", lambda k, c: one_of(word("&H", F.hex(shade(k, c)), "&"), whole(shade(k, c))), lambda x: packed(values.colour(x)))
written("colour_tags", f"concat_ws(',', {BYTES})", lambda k, c: one_of(word("&H", F.hex(shade(k, c)), "&"), F.hex(shade(k, c)), word("&&HH", F.lower(F.hex(shade(k, c))))), lambda x: packed(values.colour_tag(x)))
written("alpha_tags", "CAST(CASE q % 3 WHEN 2 THEN -(k % 65536) ELSE k % 65536 END AS INTEGER)", lambda k, c: one_of(word("&H", F.hex(k % 65_536), "&"), word(" 0x", F.hex(k % 65_536)), word("-", F.hex(k % 65_536))), values.saturated)
written("leading_ints", "CASE q % 2 WHEN 0 THEN c ELSE -(c // 100) END", lambda k, c: one_of(word(" \n", whole(c), "abc"), word("-000", whole(part(c, 100)), ".", digits(c % 100, 2))), values.leading_whole)
written("decimal_values", "CASE q % 3 WHEN 0 THEN c / 100.0::DOUBLE WHEN 1 THEN -(c / 100.0::DOUBLE) ELSE c * 1000.0::DOUBLE END", lambda k, c: one_of(word("  ", whole(part(c, 100)), ".", digits(c % 100, 2), "rest"), word("-", whole(part(c, 100)), ".", digits(c % 100, 2), "e"), word("+", whole(c), ".e3")), values.decimal)
written("decimal_prefixes", "(length(CAST(c // 100 AS VARCHAR)) + CASE q % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 2 END)", lambda k, c: one_of(word(whole(part(c, 100)), ".", digits(c % 100, 2), ",rest"), word(" ", whole(part(c, 100)), ".", digits(c % 100, 2), "e+)"), word(whole(part(c, 100)), ".Ex")), lambda x: values.decimal_prefix(x)["end"].cast("long"))
written("timecodes", "c * 10", lambda k, c: one_of(word(whole(part(c, 360_000)), ":", digits(part(c, 6_000) % 60, 2), ":", digits(part(c, 100) % 60, 2), ".", digits(c % 100, 2)), word(" 0: ", whole(part(c, 6_000)), ": ", whole(part(c, 100) % 60), ".", whole(c % 100))), text.timecode_ms)
written("srt_stamps", "c * 10", lambda k, c: word(digits(part(c, 360_000), 2), ":", digits(part(c, 6_000) % 60, 2), ":", digits(part(c, 100) % 60, 2), one_of(F.lit(","), F.lit(".")), digits(c % 100, 2), "0"), text.srt_ms)
written("script_matrices", "CASE l_returnflag WHEN 'A' THEN 'bt601-tv' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'none' ELSE 'default' END ELSE 'unknown' END", lambda k, c: F.when(F.col("l_returnflag") == "A", " TV.601 ").when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "None").otherwise(" \t")).otherwise(F.col("l_linestatus")), values.matrix)
written("keypad_alignment", "CAST(([0, 1, 2, 3, 9, 10, 11, 5, 6, 7, 5, 6, 7])[k % 13 + 1] AS INTEGER)", lambda k, c: one_of(k % 13, -(k % 13)).cast("int"), values.keypad_alignment)
written("bitrates", "CAST(CASE q % 4 WHEN 0 THEN c WHEN 1 THEN c * 10 WHEN 2 THEN c * 10000 ELSE c * 1000000000 END AS BIGINT)", lambda k, c: one_of(whole(c), word(whole(part(c, 100)), ".", digits(c % 100, 2), "k"), word(" ", whole(part(c, 100)), ".", digits(c % 100, 2), " M "), word(whole(c), "G")), text.bitrate_bps)
written("seconds_text", "CASE q % 3 WHEN 0 THEN c * 1000000 WHEN 1 THEN c * 10000 END", lambda k, c: one_of(whole(c), word(whole(part(c, 100)), ".", digits(c % 100, 2)), word(whole(c), ":", digits(c % 60, 2))), text.seconds_us)
written("attachment_mime", "CASE l_returnflag WHEN 'A' THEN 'application/x-truetype-font' WHEN 'N' THEN 'application/vnd.ms-opentype' ELSE 'application/octet-stream' END", lambda k, c: word("/a.ttf/", whole(k), F.when(F.col("l_returnflag") == "A", ".TTF").when(F.col("l_returnflag") == "N", ".x.otf").otherwise(".ttf.zip")), text.mime_type)
written("attachment_codec", "CASE l_returnflag WHEN 'A' THEN 'ttf' WHEN 'N' THEN 'otf' ELSE 'none' END", lambda k, c: word(whole(k), F.when(F.col("l_returnflag") == "A", ".TTF").when(F.col("l_returnflag") == "N", ".x.otf").otherwise("")), text.codec_id)
