"""Odd inputs of the grammars of values, with stated results."""

import pytest
from pyspark.sql import functions as F

from kinoframe.functions import text, values
from kinoframe.plans.value_queries import packed

STATED = {}


def stated(name, pairs, reads):
    STATED[name] = pairs, reads


stated("script_int", [
    ("123", 123), (" \t-5", -5), ("+7", 7), ("12abc", 12), ("abc", 0), ("", 0), ("&HFF", 255), ("&hff", 255), ("0xFF", 255), ("&H0xFF", 255),
    ("&H", 0), ("&HFF&", 255), ("&H-10", -16), (" &HFF", 0), ("&H FF", 255), ("4294967295", -1), ("4294967296", 0), ("4294967298", 2), ("-4294967295", 1),
    ("9" * 40, -1), ("&H123456789", 591751049),
], values.whole)

stated("script_bool", [
    ("yes", True), ("YES", True), (" Yes", True), ("yesterday", True), ("1", True), ("2", True), ("9" * 20, True), ("\t +3x", True),
    ("no", False), ("0", False), ("-1", False), ("true", False), ("", False), ("000", False), ("00010", True), ("ye", False),
], values.is_yes)

stated("packed_colours", [
    ("&H00FFFFFF", "255,255,255,0"), ("&H80000000", "0,0,0,128"), ("16711680", "0,0,255,0"), ("&HFF&", "255,0,0,0"), ("123", "123,0,0,0"),
    ("0x00FF00", "0,255,0,0"), ("-1", "255,255,255,255"), ("", "0,0,0,0"), ("&HAABBGGRR", "187,170,0,0"),
], lambda c: packed(values.colour(c)))

stated("colour_tags", [
    ("&HFF0000&", "0,0,255,0"), ("FF", "255,0,0,0"), ("&&HH80", "128,0,0,0"), ("&HFFFFFFFFFF&", "255,255,255,127"), ("-1", "255,255,255,255"),
    ("0x10", "16,0,0,0"), ("", "0,0,0,0"), ("zz", "0,0,0,0"),
], lambda c: packed(values.colour_tag(c)))

stated("alpha_tags", [
    ("&HFF&", 255), ("80", 128), ("&H00&", 0), ("&HFFFFFFFF&", 2147483647), ("-&H", 0), ("-F", -15), ("-FFFFFFFFFFFFFFFFFF", -2147483648), (" 0x1F", 31), ("0xg", 0),
], values.saturated)

stated("leading_ints", [
    ("12abc", 12), (" \n-5", -5), ("9" * 20, 9223372036854775807), ("-" + "9" * 20, -9223372036854775808), ("", 0), ("+", 0), ("0" * 30 + "7", 7), ("9223372036854775807", 9223372036854775807),
], values.leading_whole)

stated("decimal_values", [
    ("18", 18.0), ("  \t18.5rest", 18.5), ("-3.25", -3.25), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1.5E+2", 150.0), ("1e", 1.0), ("1e+", 1.0), (".", 0.0), ("+.", 0.0), ("abc", 0.0), ("0x10", 0.0),
], values.decimal)

stated("decimal_prefixes", [
    ("1e", "1.0/2"), ("1e+", "1.0/3"), ("1e-,rest", "1.0/3"), ("1ex", "1.0/2"), ("2.5E-1)", "0.25/6"), (" 12,", "12.0/3"), ("x", None), ("", None),
], lambda c: F.concat(values.decimal_prefix(c)["value"].cast("string"), F.lit("/"), values.decimal_prefix(c)["end"].cast("string")))

stated("timecodes", [
    ("0:00:05.00", 5000), ("1:02:03.45", 3723450), ("10:00:00.999", 36009990), ("0:00:00.5", 50), (" 0: 00: 05.00", 5000), ("-1:00:00.00", -3600000),
    ("0:00:05", None), ("0 :00:00.00", None), ("::", None), ("garbage", None), ("", None),
], text.timecode_ms)

stated("script_matrices", [
    ("", "default"), ("  \t ", "default"), (" TV.601 ", "bt601-tv"), ("pc.709", "bt709-pc"), ("None", "none"), ("tv.240M", "smpte240m-tv"), ("pc.fcc", "fcc-pc"), ("bt2020", "unknown"),
], values.matrix)

stated("keypad_alignment", [
    (1, 1), (2, 2), (3, 3), (4, 9), (5, 10), (6, 11), (7, 5), (8, 6), (9, 7), (0, 0), (-5, 10), (10, 5), (-2147483648, 2), (12, 7), (-9, 7),
], values.keypad_alignment)

stated("bitrates", [
    ("500k", 500000), ("5M", 5000000), ("2.5M", 2500000), ("1G", 1000000000), (" 500k ", 500000), ("800", 800), ("1.5 k", 1500), ("1e3k", 1000000), ("0.0004k", 0),
    ("", None), ("k", None), ("-5k", None), ("0", None), ("fast", None), ("5kk", None), ("inf", None),
], text.bitrate_bps)

stated("seconds_text", [
    ("10", 10000000), ("2.5", 2500000), ("0.1234567", 123457), ("0.1234564", 123456), ("1234567890.5", 1234567890500000), ("0", 0),
    ("00:01", None), ("-1", None), ("+1", None), ("1.", None), (".5", None), ("1.2.3", None), ("1e3", None), ("", None), ("9" * 30, None),
], text.seconds_us)

stated("attachment_mime", [
    ("/a.b/f.TTF", "application/x-truetype-font"), ("x.otf", "application/vnd.ms-opentype"), ("x.ttc", "application/octet-stream"), ("x.jpeg", "application/octet-stream"), ("x.Png", "application/octet-stream"),
    ("/a.ttf/f", "application/octet-stream"), (".ttf", "application/octet-stream"), ("", "application/octet-stream"), ("é.otf", "application/vnd.ms-opentype"),
], text.mime_type)

stated("attachment_codec", [("a.TTF", "ttf"), ("b.c.otf", "otf"), ("b.woff", "none"), ("ttf", "none"), ("a.ttf.zip", "none")], text.codec_id)

stated("srt_stamps", [("00:00:01,500", 1500), ("01:02:03.004", 3723004), ("100:00:00,000", 360000000), ("0:00:00", None), ("00:00:01,5", None), ("", None)], text.srt_ms)


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated_results(spark, name):
    pairs, reads = STATED[name]
    kind = "long" if isinstance(pairs[0][0], int) else "string"
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], f"i int, x {kind}")
    assert [r.v for r in rows.select("i", reads(F.col("x").cast("int") if kind == "long" else F.col("x")).alias("v")).orderBy("i").collect()] == [v for _, v in pairs]
