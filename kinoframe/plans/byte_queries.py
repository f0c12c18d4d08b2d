"""Queries over byte formats, PCM and live streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.operators import bitstream, gop, samples
from kinoframe.plans.scan_queries import UPTO, W
from kinoframe.scratch import shared_path
from kinoframe.sources import media
from kinoframe.sources.tables import CHUNKS, PACKETS, chunks, micros, packets, table
from kinoframe.streaming import live

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def access_units(spark, d):
    """Annex-B packets of three units: parameter sets before key slices, with 3- and 4-byte start codes and padding."""
    body = F.rpad(F.lit(""), 4, "A")
    key = F.concat(F.lit("0000000167"), F.lit("4d401e"), F.lit("00000168"), F.lit("ee3c80"), F.lit("00000165"), F.repeat(body, 3))
    plain = F.concat(F.lit("00000141"), F.hex(F.col("seq") % 16 + 16), F.lit("0000000141"), F.lit("80aa0000"))
    return packets(spark, d).select("seq", "is_key", F.unhex(F.when(F.col("is_key"), key).otherwise(plain)).alias("data"))


@query("nal_scan", f"SELECT seq, CASE WHEN is_key THEN 3 ELSE 2 END AS nal_count, is_key AS has_idr, is_key AS has_parameter_set FROM ({PACKETS})")
def _(spark, d):
    return bitstream.scan(bitstream.nal_units(access_units(spark, d))).select("seq", "nal_count", "has_idr", "has_parameter_set")


@query(
    "nal_units",
    f"""SELECT seq, v.* FROM ({PACKETS}), (VALUES (true, 0, 7, 4), (true, 1, 8, 4), (true, 2, 5, 7), (false, 0, 1, 2), (false, 1, 1, 3)) v(k, nal_no, nal_type, size) WHERE is_key = v.k""".replace("SELECT seq, v.*", "SELECT seq, v.nal_no, v.nal_type, v.size"),
)
def _(spark, d):
    return bitstream.nal_units(access_units(spark, d)).select("seq", F.inline("nals")).select("seq", "nal_no", "nal_type", "size")


@query("nal_length_prefixed", f"SELECT seq, CASE WHEN is_key THEN 27 ELSE 13 END AS size, CASE WHEN is_key THEN 3 ELSE 2 END AS again FROM ({PACKETS})")
def _(spark, d):
    framed = bitstream.length_prefixed(bitstream.nal_units(access_units(spark, d))).select("seq", F.octet_length("sample").alias("size"), "sample")
    return bitstream.nal_units(framed, prefixed=True, binary="sample").select("seq", "size", F.size("nals").alias("again"))


def tags(spark, d):
    body = F.when(F.col("is_key"), F.lit(b"\x17\x01\x00\x00\x00")).when(F.col("is_corrupt"), F.lit(b"\x17\x00\x01")).otherwise(F.lit(b"\xaf\x01\x21"))
    kind = F.when(F.col("is_key") | F.col("is_corrupt"), 9).otherwise(8)
    return packets(spark, d).withColumn("body", body).withColumn("tag", bitstream.flv_tag(kind.cast("long"), F.col("seq") * 40_000, F.col("body")))


@query(
    "flv_round_trip",
    f"""SELECT stream_index, CAST(row_number() OVER ({W}) - 1 AS INTEGER) AS tag_no, CASE WHEN is_key OR is_corrupt THEN 9 ELSE 8 END AS tag_type, seq * 40000 AS timestamp_ms, CASE WHEN is_key THEN 5 ELSE 3 END AS size,
        is_key AS key_picture, is_corrupt AS header FROM ({PACKETS})""",
)
def _(spark, d):
    found = bitstream.flv_tags(bitstream.flv_stream(tags(spark, d), "stream_index"))
    return found.select("stream_index", "tag_no", "tag_type", "timestamp_ms", F.octet_length("body").alias("size"), bitstream.is_video_key(F.col("body")).alias("key_picture"), bitstream.is_video_header(F.col("body")).alias("header"))


@query(
    "aac_config",
    """SELECT l_orderkey, l_linenumber, CAST(1 + l_linenumber % 4 AS INTEGER) AS object_type, CAST(([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350])[l_partkey % 13 + 1] AS INTEGER) AS sample_rate,
        CAST(l_quantity AS INTEGER) % 8 AS channels, 'mp4a.40.' || (1 + l_linenumber % 4) AS codec FROM lineitem""",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    v = (1 + F.col("l_linenumber") % 4) * 2048 + F.col("l_partkey") % 13 * 128 + F.col("l_quantity").cast("int") % 8 * 8
    return rows.select("l_orderkey", "l_linenumber", bitstream.aac_config(bitstream.big_endian(v.cast("long"), 2)).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query("audio_collected", f"SELECT asset_id, CAST(sum(len(data)) AS INTEGER) AS samples, arg_min(data[1], \"index\")::DOUBLE AS first, arg_max(data[len(data)], \"index\")::DOUBLE AS last, 1::BIGINT AS layouts FROM ({CHUNKS}) GROUP BY 1")
def _(spark, d):
    return samples.collected(chunks(spark, d)).select("asset_id", F.size("data").alias("samples"), F.element_at("data", 1).cast("double").alias("first"), F.element_at("data", -1).cast("double").alias("last"), "layouts")


@query(
    "audio_reframed",
    f"""WITH s AS (SELECT asset_id, "index" * 64 + i AS n, x FROM (SELECT asset_id, "index", generate_subscripts(data, 1) - 1 AS i, unnest(data)::DOUBLE AS x FROM ({CHUNKS})))
        SELECT asset_id, n // 100 AS frame, CAST(count(*) AS INTEGER) AS size, arg_min(x, n) AS first, arg_max(x, n) AS last FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    return samples.reframed(chunks(spark, d), 100).select("asset_id", "frame", F.size("data").alias("size"), F.element_at("data", 1).cast("double").alias("first"), F.element_at("data", -1).cast("double").alias("last"))


@query("audio_mono", f'SELECT asset_id, "index", 32 AS size, (data[1]::DOUBLE + data[2]::DOUBLE) / 2 AS first FROM ({CHUNKS})')
def _(spark, d):
    return samples.mixed_down(chunks(spark, d), 2).select("asset_id", "index", F.size("data").alias("size"), F.element_at("data", 1).alias("first"))


@query("audio_s16", f'SELECT asset_id, "index", greatest(-32768, least(32767, CAST(round(data[1]::DOUBLE * 32768) AS INTEGER))) AS first FROM ({CHUNKS})')
def _(spark, d):
    return samples.as_s16(chunks(spark, d)).select("asset_id", "index", F.element_at("data", 1).alias("first"))


@query("audio_resampled", f'SELECT asset_id, 8000 AS sample_rate, CAST(sum(len(data)) // 2 AS INTEGER) AS samples, arg_min(data[3], "index")::DOUBLE AS second FROM ({CHUNKS}) GROUP BY 1')
def _(spark, d):
    second = F.when(F.col("first") <= 1, F.get("data", (1 - F.col("first")).cast("int")))
    blocks = samples.resampled(chunks(spark, d), 8000).select("asset_id", "sample_rate", F.size("data").alias("n"), second.alias("second"))
    return blocks.groupBy("asset_id", "sample_rate").agg(F.sum("n").cast("int").alias("samples"), F.max("second").alias("second"))


@query(
    "audio_resampled_up",
    f"""WITH s AS (SELECT asset_id, "index" * 64 + i AS n, x FROM (SELECT asset_id, "index", generate_subscripts(data, 1) - 1 AS i, unnest(data)::DOUBLE AS x FROM ({CHUNKS}))),
        l AS (SELECT asset_id, count(*) AS total FROM s GROUP BY 1), j AS (SELECT asset_id, total, unnest(range(total * 44100 // 16000)) AS j FROM l)
        SELECT j.asset_id, j.j AS place, a.x + (coalesce(b.x, a.x) - a.x) * ((j.j * 16000) % 44100 / 44100.0::DOUBLE) AS x
        FROM j JOIN s a ON a.asset_id = j.asset_id AND a.n = j.j * 16000 // 44100 LEFT JOIN s b ON b.asset_id = j.asset_id AND b.n = a.n + 1""",
)
def _(spark, d):
    new = samples.resampled(chunks(spark, d), 44_100)
    return new.select("asset_id", "first", F.posexplode("data").alias("i", "x")).select("asset_id", (F.col("first") + F.col("i")).alias("place"), "x")


# --- live ---

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, d):
    return spark.readStream.schema(SCHEMA).parquet(f"{d}/event[s].parquet")  # a pattern may name a single file


def packet_stream(spark, d):
    return event_stream(spark, d).select(F.col("user_id").alias("stream_index"), F.col("event_id").alias("seq"), micros("ts").alias("pts_us"), F.length("props").cast("long").alias("size"), (F.col("event_type") == "purchase").alias("is_key"))


@query("live_gated", f"SELECT stream_index, seq FROM (SELECT *, max(is_key::INT) OVER {UPTO} AS seen FROM ({PACKETS})) WHERE seen = 1")
def _(spark, d):
    return live.drained(live.gated(packet_stream(spark, d)), "append", "live-gated", "stream_index long, seq long")


# packet after packet: a key packet closes what is open; the sixth packet or the 50th byte and more clear it
CACHE = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT stream_index, seq, is_key, size, row_number() OVER ({W}) AS r FROM ({PACKETS})),
        f AS (SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS size, 0::BIGINT AS grp, 0::BIGINT AS run, 0::BIGINT AS nxt, 0::BIGINT AS n, 0::BIGINT AS b FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT stream_index, r, seq, size, grp, run, run + over, CASE WHEN over = 1 THEN 0 ELSE n END, CASE WHEN over = 1 THEN 0 ELSE b END FROM (
            SELECT *, CASE WHEN n > 5 OR b > 49 THEN 1 ELSE 0 END AS over FROM (
                SELECT p.stream_index, p.r, p.seq, p.size, f.grp + CASE WHEN closes THEN 1 ELSE 0 END AS grp, f.nxt AS run, CASE WHEN closes THEN 1 ELSE f.n + 1 END AS n, CASE WHEN closes THEN p.size ELSE f.b + p.size END AS b
                FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1, LATERAL (SELECT p.is_key AND f.n > 0 AS closes)))),
        g AS (SELECT *, max(nxt) OVER (PARTITION BY stream_index, grp) AS stays, max(grp) OVER (PARTITION BY stream_index) AS last FROM f WHERE r > 0),
        k AS (SELECT * FROM g WHERE run = stays AND grp >= last - 3)"""


@query("gop_cached", f"{CACHE} SELECT stream_index, seq, grp AS \"group\" FROM k")
def _(spark, d):
    return gop.cached(packets(spark, d), 3, 5, 49, cell=2_500).select("stream_index", "seq", "group")


@query(
    "live_gop_cache",
    f"""{CACHE} SELECT s.stream_index, count(DISTINCT grp) AS groups, count(grp) AS packets, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, min(seq) AS first_seq
        FROM (SELECT DISTINCT stream_index FROM p) s LEFT JOIN k USING (stream_index) GROUP BY 1""",
)
def _(spark, d):
    """Three batches or more, of which the last of a stream counts."""
    parts = packets(spark, d).select("stream_index", "seq", "size", "is_key", F.call_function("div", F.col("seq") * 4, F.greatest(F.lit(1), F.lit(table(spark, d, "events").count()))).alias("part"))
    path = shared_path(spark, "live-packets")
    for k in range(4):  # files in order of arrival, one a batch
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("stream_index long, seq long, size long, is_key boolean").option("maxFilesPerTrigger", 1).parquet(path)
    states = live.drained(live.gop_cache(stream, 3, 5, 49).withColumn("at", F.current_timestamp()), "update", "live-gop", f"{live.CACHED}, at timestamp", store=live.STORE)
    return states.groupBy("stream_index").agg(F.max_by(F.struct("groups", "packets", "bytes", "first_seq"), "at").alias("s")).select("stream_index", "s.*")


@query("live_windows", "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    stream = event_stream(spark, d).withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))
    counted = live.windows(stream, "1 day", "2 days").select(F.unix_micros("start").alias("start_us"), "event_type", "n")
    return live.drained(counted, "complete", "live-windows", "start_us long, event_type string, n long", per_batch=False)


@query(
    "idle_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN pts_us - lag(pts_us) OVER ({W}) < 43200000000 THEN 0 ELSE 1 END AS opens FROM ({PACKETS})), s AS (SELECT *, sum(opens) OVER {UPTO} AS session FROM g)
        SELECT stream_index, count(*) AS n, min(pts_us) AS first_us, max(pts_us) AS last_us FROM s GROUP BY stream_index, session""",
)
def _(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("stream_index"), F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)))").alias("ts"))
    return live.idle_sessions(events, "stream_index", "12 hours").select("stream_index", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


# --- files written from a table and read in ranges ---

SAID = "FROM conversations WHERE text IS NOT NULL"


@query("flv_ranges", f"SELECT CASE WHEN role = 'user' THEN 9 ELSE 8 END AS tag_type, conv_id % 100000 * 100 + turn AS timestamp_ms, octet_length(encode(text)) AS size, md5(text) AS data {SAID}")
def _(spark, d):
    media.register(spark)
    path = shared_path(spark, "flv")
    rows = table(spark, d, "conversations").where("text is not null")
    tags = rows.select(F.when(F.col("role") == "user", 9).otherwise(8).alias("tag_type"), (F.col("conv_id") % 100_000 * 100 + F.col("turn")).alias("timestamp_ms"), F.col("text").cast("binary").alias("data"))
    tags.repartitionByRange(4, "timestamp_ms").sortWithinPartitions("timestamp_ms").write.format("flv").mode("append").save(path)
    back = spark.read.format("flv").option("rangeBytes", 1 << 14).load(path)
    return back.select("tag_type", "timestamp_ms", "size", F.md5("data").alias("data"))


@query("flv_stamps", f"SELECT CASE WHEN role = 'user' THEN 9 ELSE 8 END AS tag_type, count(*) AS tags, max(conv_id % 100000 * 100 + turn) AS last_ms {SAID} GROUP BY 1")
def _(spark, d):
    """Headers alone: bodies are not read."""
    media.register(spark)
    path = shared_path(spark, "flv")
    rows = table(spark, d, "conversations").where("text is not null")
    tags = rows.select(F.when(F.col("role") == "user", 9).otherwise(8).alias("tag_type"), (F.col("conv_id") % 100_000 * 100 + F.col("turn")).alias("timestamp_ms"), F.col("text").cast("binary").alias("data"))
    tags.repartition(3).write.format("flv").mode("append").save(path)
    back = spark.read.format("flv").option("rangeBytes", 1 << 16).schema("tag_type int, timestamp_ms long").load(path)
    return back.groupBy("tag_type").agg(F.count(F.lit(1)).alias("tags"), F.max("timestamp_ms").alias("last_ms"))


# vectors of 64 numbers as 16-bit sound, a piece each: what is read is what was written, wherever a file is cut
@query(
    "wav_ranges",
    """SELECT 16000 AS sample_rate, md5(h) AS pcm, count(*) AS n FROM (SELECT vec_id, string_agg(printf('%02X%02X', v & 255, (v >> 8) & 255), '' ORDER BY i) AS h FROM (
        SELECT vec_id, i, CAST(trunc(embedding[i]::DOUBLE * 30000) AS INTEGER) AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY 1) GROUP BY 2""",
)
def _(spark, d):
    media.register(spark)
    path = shared_path(spark, "wav")
    number = lambda c: F.lpad(F.hex((c.cast("double") * 30_000).cast("int").cast("long").bitwiseAND(F.lit(0xFFFF))), 4, "0")
    piece = lambda c: F.concat(F.substring(number(c), 3, 2), F.substring(number(c), 1, 2))
    rows = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", piece), "")).alias("pcm"))
    rows.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").select("pcm").write.format("wav").mode("append").save(path)
    back = spark.read.format("wav").option("rangeBytes", 5_000).option("frames", 64).load(path)
    return back.groupBy("sample_rate", F.md5(F.hex("pcm").cast("binary")).alias("pcm")).agg(F.count(F.lit(1)).alias("n"))
