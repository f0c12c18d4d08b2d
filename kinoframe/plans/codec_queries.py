"""Queries over codec configurations, written by column functions from a table's numbers and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.operators import codecs
from kinoframe.operators.codecs import exp_golomb, field, packed_bits
from kinoframe.plans.vectors import row_vectors
from kinoframe.sources.tables import PACKETS, STREAMS, packets, streams, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


def sps(number, width, height, profile=66):
    """A sequence set of a picture of an even height, cropped to it."""
    lit = lambda n: exp_golomb(F.lit(n))
    down = F.ceil(height / 16)
    high = F.concat(lit(1), lit(2), lit(2), F.lit("00")) if profile == 100 else F.lit("")
    crop = F.concat(F.lit("1"), lit(0), lit(0), lit(0), exp_golomb(F.call_function("div", down * 16 - height, F.lit(2))))
    return F.concat(
        field(F.lit(profile), 8), field(F.lit(0xC0), 8), field(F.lit(30), 8), exp_golomb(number), high, lit(0), lit(2), lit(1), F.lit("0"),
        exp_golomb(F.call_function("div", width, F.lit(16)) - 1), exp_golomb(down - 1), F.lit("11"), crop, F.lit("0"),
    )


def pps(number, of):
    lit = lambda n: exp_golomb(F.lit(n))
    return F.concat(exp_golomb(number), exp_golomb(of), F.lit("00"), lit(0), lit(0), lit(0), F.lit("000"), lit(0), lit(0), lit(0), F.lit("100"))


def configured(spark, d, profile=66):
    """Streams with an Annex-B configuration of their size."""
    s = streams(spark, d).select("stream_index", "width", (F.col("height") + F.col("height") % 2).alias("height"))
    number = F.col("stream_index") % 4
    start = F.lit(b"\x00\x00\x01")
    data = F.concat(start, F.lit(b"\x67"), packed_bits(sps(number, F.col("width"), F.col("height"), profile)), start, F.lit(b"\x68"), packed_bits(pps(number + 1, number)))
    return s.select("stream_index", data.alias("data"))


SIZES = f"SELECT stream_index, CAST(stream_index % 4 AS INTEGER) AS id, CAST(width AS INTEGER) AS width, CAST(height + height % 2 AS INTEGER) AS height FROM ({STREAMS})"


@query("avc_configurations", f"SELECT *, 66 AS profile, 30 AS level, 1 AS chroma, 8 AS luma_bits, 'avc1.42C01E' AS codec, 1 AS n_sps, 1 AS n_pps, true AS same FROM ({SIZES})")
def _(spark, d):
    found = codecs.configurations(configured(spark, d))
    again = codecs.configurations(found.select("stream_index", F.col("record").alias("data"), F.col("fingerprint").alias("before")))
    same = again.select("stream_index", (F.col("fingerprint") == F.col("before")).alias("same"))
    return found.join(same, "stream_index").select("stream_index", "id", "profile", "level", "chroma", "luma_bits", "width", "height", "codec", "n_sps", "n_pps", "same")


@query("avc_records", f"SELECT stream_index, width, height, '0164C01EFFE1' AS head, 'FDFAFA00' AS tail, 10 AS luma_bits FROM ({SIZES})")
def _(spark, d):
    found = codecs.configurations(configured(spark, d, 100))
    text = F.hex("record")
    return found.select("stream_index", "width", "height", F.substring(text, 1, 12).alias("head"), F.right(text, F.lit(8)).alias("tail"), "luma_bits")


@query("avc_sequence_sets", f"SELECT stream_index, id, width, height FROM ({SIZES})")
def _(spark, d):
    s = streams(spark, d)
    data = F.concat(F.lit(b"\x67"), packed_bits(sps(F.col("stream_index") % 4, F.col("width"), F.col("height") + F.col("height") % 2)))
    return codecs.sequence_sets(s.select("stream_index", data.alias("data"))).select("stream_index", "id", "width", "height")


@query(
    "avc_changes",
    f"SELECT stream_index, seq FROM (SELECT *, lag(seq // 100) OVER (PARTITION BY stream_index ORDER BY seq) AS before FROM ({PACKETS})) WHERE before IS NOT NULL AND before <> seq // 100",
)
def _(spark, d):
    epoch = F.call_function("div", F.col("seq"), F.lit(100))
    start = F.lit(b"\x00\x00\x01")
    # an epoch has a size of its own; headers change from packet to packet without a change of configuration
    body = packed_bits(sps(F.lit(0).cast("long"), (epoch % 200 + 1) * 16, (F.call_function("div", epoch, F.lit(200)) + 1) * 16))
    header = F.when(F.col("seq") % 2 == 0, F.lit(b"\x67")).otherwise(F.lit(b"\x47"))
    data = F.concat(start, header, body, start, F.lit(b"\x68"), packed_bits(pps(F.lit(0).cast("long"), F.lit(0).cast("long"))))
    return codecs.changes(codecs.configurations(packets(spark, d).select("stream_index", "seq", data.alias("data")))).select("stream_index", "seq")




def whole(*bits: str) -> str:
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return f"{int(text, 2):0{len(text) // 4}x}"


def sps_by_hand(profile=66, constraints=0, body="1" + "1" + "011" + "010" + "0" + "000010100" + "0001111" + "11" + "0" + "0", close="1") -> str:
    """Set 0, frame numbers of 4 bits, order type 2, 1 reference, 20 x 15 blocks, frames, nothing cropped, no usability."""
    return "67" + whole(f"{profile:08b}{constraints:08b}{30:08b}", body, close)


PPS_BY_HAND = "68" + whole("1", "1", "00", "1", "1", "1", "000", "1", "1", "1", "100", "1")
ANNEX = "000001"

row_vectors(query, "avc_problems", "BOOLEAN", [
    (ANNEX + sps_by_hand() + ANNEX + PPS_BY_HAND, False),
    (ANNEX + sps_by_hand(constraints=1) + ANNEX + PPS_BY_HAND, True),  # reserved bits
    (ANNEX + sps_by_hand(close="0" + "1") + ANNEX + PPS_BY_HAND, True),  # no stop bit where it must be
    (ANNEX + sps_by_hand() + "80" + ANNEX + PPS_BY_HAND, True),  # bytes after the end
    (ANNEX + sps_by_hand()[:-4] + ANNEX + PPS_BY_HAND, True),  # cut off
    (ANNEX + PPS_BY_HAND + ANNEX + sps_by_hand(), True),  # the picture set in front
    (ANNEX + sps_by_hand(), True),  # no picture set
    (ANNEX + sps_by_hand() + ANNEX + PPS_BY_HAND + ANNEX + "6588", True),  # a slice
    (ANNEX + sps_by_hand() + ANNEX + "68" + whole("1", "010", "00", "1", "1", "1", "000", "1", "1", "1", "100", "1"), True),  # another sequence set
    (ANNEX + sps_by_hand() + ANNEX + "68" + whole("1", "1", "00", "1", "1", "1", "011", "1", "1", "1", "100", "1"), True),  # bipred 3
    (ANNEX + sps_by_hand(body="1" + "1" + "00100" + "010" + "0" + "000010100" + "0001111" + "11" + "0" + "0") + ANNEX + PPS_BY_HAND, True),  # order type 3
    ("01" + "42001e" + "ff" + "e1" + f"{len(sps_by_hand()) // 2:04x}" + sps_by_hand() + "01" + f"{len(PPS_BY_HAND) // 2:04x}" + PPS_BY_HAND, False),
    ("01" + "4d001e" + "ff" + "e1" + f"{len(sps_by_hand()) // 2:04x}" + sps_by_hand() + "01" + f"{len(PPS_BY_HAND) // 2:04x}" + PPS_BY_HAND, True),  # another profile
    ("01" + "42001e" + "fd" + "e1" + f"{len(sps_by_hand()) // 2:04x}" + sps_by_hand() + "01" + f"{len(PPS_BY_HAND) // 2:04x}" + PPS_BY_HAND, True),  # lengths of 2 bytes
    ("01" + "42001e" + "ff" + "c1" + f"{len(sps_by_hand()) // 2:04x}" + sps_by_hand() + "01" + f"{len(PPS_BY_HAND) // 2:04x}" + PPS_BY_HAND, True),  # reserved bits
    ("01" + "42001e" + "ff" + "e1" + "00ff" + sps_by_hand(), True), ("0142001effe0", True), ("", True), ("ffffff", True),
], lambda rows: codecs.configurations(rows).withColumn("v", F.col("problem").isNotNull()))

row_vectors(query, "avc_sizes", "VARCHAR", [
    (sps_by_hand(), "320x240"), (sps_by_hand(body="1" + "1" + "011" + "010" + "0" + "000010100" + "0001111" + "11" + "1" + "1" + "1" + "1" + "00101" + "0"), "320x232"),
    # fields: heights count twice, and so do crop units
    (sps_by_hand(body="1" + "1" + "011" + "010" + "0" + "000010100" + "0001111" + "00" + "1" + "0" + "0"), "320x480"),
    (sps_by_hand(body="1" + "1" + "1" + "1" + "010" + "0" + "000010100" + "0001111" + "11" + "0" + "0"), "320x240"),
    # order type 1 with two offsets
    (sps_by_hand(body="1" + "1" + "010" + "1" + "011" + "1" + "011" + "010" + "00110" + "010" + "0" + "000010100" + "0001111" + "11" + "0" + "0"), "320x240"),
    # 4:4:4 of 8 bits with a scaling list of one step to zero
    (sps_by_hand(profile=244, body="1" + "00100" + "0" + "1" + "1" + "0" + "1" + "1" + "000010001" + "0" * 11 + "1" + "011" + "010" + "0" + "000010100" + "0001111" + "11" + "0" + "0"), "320x240"),
], lambda rows: codecs.sequence_sets(rows).withColumn("v", F.concat("width", F.lit("x"), "height")))

row_vectors(query, "rbsp_bytes", "VARCHAR", [
    ("67000003010000030000", "670000010000000" + "0"), ("000003", "0000"), ("00000303", "000003"), ("0000000003", "00000000"), ("000003000003", "00000000"), ("0102", "0102"), ("", ""),
], lambda rows: codecs.by_rows(rows, "data", lambda b: (codecs.unescaped(b).hex(),), "v string"))

# the numbers of a line of an order, each as zeros, as many as it has bits less one, and its bits
@query("exp_golomb", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) || ' ' || CAST(l_quantity AS BIGINT) || ' ' || l_linenumber || ' 0 ' || CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem")
def _(spark, d):
    def bits(n):
        text = F.bin(n.cast("long") + 1)
        return F.concat(F.repeat(F.lit("0"), F.length(text) - 1), text)

    whole_ = F.concat(bits(F.col("l_partkey")), bits(F.col("l_quantity")), bits(F.col("l_linenumber")), F.lit("1"), bits(F.round(F.col("l_extendedprice") * 100)))
    padded = F.rpad(whole_, F.call_function("div", F.length(whole_) + 7, F.lit(8)).cast("int") * 8, F.lit("0"))
    data = F.unhex(F.array_join(F.transform(F.regexp_extract_all(padded, F.lit("[01]{8}"), 0), lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", data.alias("data"))
    return codecs.by_rows(rows, "data", lambda b: (codes(b),), "v string").select("l_orderkey", "l_linenumber", "v")


def codes(data: bytes) -> str | None:
    bits = codecs.Bits(data)
    try:
        return " ".join(str(bits.code()) for _ in range(5))
    except codecs.Broken:
        return None




def shown(rows):
    part = [F.col(c).cast("string") for c in ("object_type", "sample_rate", "channels")]
    found = codecs.audio_configurations(rows)
    return found.withColumn("v", F.when(F.col("problem").isNull(), F.concat_ws("/", *part, F.coalesce("extension", F.lit("-")), F.coalesce(F.col("extended_rate").cast("string"), F.lit("-")), "codec")))


row_vectors(query, "aac_configurations", "VARCHAR", [
    ("1210", "2/44100/2/-/-/mp4a.40.2"), ("1190", "2/48000/2/-/-/mp4a.40.2"), ("1588", "2/8000/1/-/-/mp4a.40.2"), ("11b8", "2/48000/8/-/-/mp4a.40.2"),
    ("2b118800", "2/24000/2/sbr/48000/mp4a.40.5"), (whole("11101", "0110", "0001", "0011", "00010", "000"), "2/24000/1/ps/48000/mp4a.40.29"),
    (whole("11111", "001010", "0011", "0010"), "42/48000/2/-/-/mp4a.40.42"), (whole("00010", "1111", f"{12345:024b}", "0001", "000"), "2/12345/1/-/-/mp4a.40.2"),
    # a program: a pair in front, one behind, a low one
    (whole("00010", "0100", "0000", "000", "0000", "01", "0100", "0001", "0000", "0001", "01", "000", "0000", "000", "10000", "00000", "0000"), "2/44100/4/-/-/mp4a.40.2"),
    (whole("00010", "0100", "0000", "000", "0000", "01", "0011", "0001", "0000", "0001", "01", "000", "0000", "000", "10000", "00000", "0000"), None),
    (whole("00010", "1101", "0010", "000"), None), ("0110", None), ("12", None), ("", None), (whole("00010", "0100", "1000", "000"), None),
], shown)
