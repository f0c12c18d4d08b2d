"""Queries over fan-out to watchers and composite jobs, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.operators import fanout, recipes
from kinoframe.plans.scan_queries import AT, DAY, UPTO, W
from kinoframe.sources.tables import PACKETS, STREAMS, packets, streams, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


# --- fan-out: a channel a user, a header every so often ---

MEDIA = f"""SELECT stream_index AS channel, seq, CASE WHEN event_type IN ('purchase', 'view', 'error') THEN 'video' ELSE 'audio' END AS kind, is_key,
            event_type = 'error' AS is_header, size, CAST(seq % 3 AS VARCHAR) AS digest FROM ({PACKETS})"""
EPOCH = f"""SELECT *, CAST(sum(changed) OVER (PARTITION BY channel ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (
            SELECT *, CASE WHEN is_header AND prev IS NOT NULL AND prev <> digest THEN 1 ELSE 0 END AS changed FROM (
            SELECT *, lag(digest) OVER (PARTITION BY channel, kind, is_header ORDER BY seq) AS prev FROM ({MEDIA})))"""
WATCHERS = f"""SELECT channel, CAST(k AS BIGINT) AS watcher, lo + (hi - lo) * (k + 1) // 4 AS join_seq FROM (SELECT stream_index AS channel, min(seq) AS lo, max(seq) AS hi FROM ({PACKETS}) GROUP BY 1), range(3) t(k)"""


def media(spark, d):
    p = packets(spark, d)
    kind = F.when(F.col("event_type").isin("purchase", "view", "error"), "video").otherwise("audio")
    return p.select(F.col("stream_index").alias("channel"), "seq", kind.alias("kind"), "is_key", (F.col("event_type") == "error").alias("is_header"), "size", (F.col("seq") % 3).cast("string").alias("digest"))


def watchers(spark, d):
    """Three watchers a channel, who join at a quarter, a half and three quarters of it."""
    span = packets(spark, d).groupBy(F.col("stream_index").alias("channel")).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    join = F.col("lo") + F.call_function("div", (F.col("hi") - F.col("lo")) * (F.col("watcher") + 1), F.lit(4))
    return span.withColumn("watcher", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).select("channel", "watcher", join.alias("join_seq"))


@query("config_epochs", f"SELECT channel, seq, epoch FROM ({EPOCH})")
def _(spark, d):
    return fanout.config_epochs(media(spark, d)).select("channel", "seq", "epoch")


@query(
    "fan_out",
    f"""WITH m AS ({MEDIA}), v AS (SELECT channel, bool_and(kind <> 'video') AS audio_only FROM m GROUP BY 1), w AS ({WATCHERS}),
        j AS (SELECT m.*, watcher, audio_only, coalesce(max(is_key AND kind = 'video') OVER (PARTITION BY m.channel, watcher ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen
              FROM m JOIN w USING (channel) JOIN v USING (channel) WHERE seq >= join_seq)
        SELECT channel, watcher, seq FROM j WHERE is_header OR seen OR CASE WHEN kind = 'video' THEN is_key ELSE audio_only END""",
)
def _(spark, d):
    return fanout.delivered(media(spark, d), watchers(spark, d))


@query(
    "late_join_replay",
    f"""WITH g AS (SELECT *, CAST(sum(CASE WHEN is_key AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY channel, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop_id
              FROM (SELECT *, row_number() OVER (PARTITION BY channel, epoch ORDER BY seq) AS r FROM ({EPOCH}))),
        j AS (SELECT g.*, watcher, max(epoch) OVER (PARTITION BY g.channel, watcher) AS now FROM g JOIN ({WATCHERS}) w USING (channel) WHERE seq < join_seq),
        k AS (SELECT * FROM j WHERE epoch = now AND NOT is_header),
        b AS (SELECT channel, watcher, gop_id, sum(size) AS bytes, bool_or(is_key) AS keyed FROM k GROUP BY 1, 2, 3),
        s AS (SELECT *, sum(bytes) OVER (PARTITION BY channel, watcher ORDER BY gop_id DESC ROWS UNBOUNDED PRECEDING) AS suffix, row_number() OVER (PARTITION BY channel, watcher ORDER BY gop_id DESC) AS n FROM b)
        SELECT channel, watcher, seq FROM k JOIN s USING (channel, watcher, gop_id) WHERE suffix <= 400 AND n <= 3 AND (keyed OR kind = 'audio')""",
)
def _(spark, d):
    return fanout.replayed(media(spark, d), watchers(spark, d), budget=400, keep=3)


@query("idle_connections", f"SELECT conn_id, last_us, CASE WHEN silent >= {2 * DAY} THEN 'timeout' WHEN silent >= {DAY // 2} THEN 'ping' END AS due FROM (SELECT stream_index AS conn_id, max(pts_us) AS last_us, {AT + 20 * DAY} - max(pts_us) AS silent FROM ({PACKETS}) WHERE pts_us < {AT + 20 * DAY} GROUP BY 1)")
def _(spark, d):
    rows = packets(spark, d).where(F.col("pts_us") < AT + 20 * DAY).select(F.col("stream_index").alias("conn_id"), F.col("pts_us").alias("at_us"))
    return fanout.idle(rows, AT + 20 * DAY, DAY // 2, 2 * DAY)


@query("pressure_levels", f"SELECT seq, CASE WHEN q >= 4000 THEN 'critical' WHEN q >= 2000 THEN 'high' WHEN q >= 1000 THEN 'warning' ELSE 'normal' END AS level FROM (SELECT seq, sum(size) OVER {UPTO} AS q FROM ({PACKETS}))")
def _(spark, d):
    from kinoframe.operators.scan import ordered, upto

    rows = packets(spark, d).withColumn("q", F.sum("size").over(upto(ordered())))
    return rows.select("seq", fanout.pressure(F.col("q"), 1000, 2000, 4000).alias("level"))


@query("oversized_headers", f"SELECT seq FROM ({PACKETS}) WHERE is_corrupt AND size > 20")
def _(spark, d):
    return packets(spark, d).where(fanout.oversized_header(F.col("size"), F.col("is_corrupt"), 20)).select("seq")


# --- recipes ---

RENDITIONS = [("high", 1920, 1080, 5_000_000), ("mid", 1280, 720, 2_500_000), ("low", 640, 360, 800_000)]
LADDER = "(VALUES " + ", ".join(f"('{n}', {w}, {h}, {b}::BIGINT)" for n, w, h, b in RENDITIONS) + ") r(rendition, width, height, bps)"


@query(
    "ladder_segments",
    f"""WITH s AS (SELECT *, max(cell) OVER {UPTO} AS segment FROM (SELECT *, CASE WHEN is_key THEN (pts_us - min(pts_us) OVER (PARTITION BY stream_index)) // {DAY} ELSE 0 END AS cell FROM ({PACKETS}))),
        g AS (SELECT stream_index, segment, count(*) AS packets, min(pts_us) AS start_us, max(pts_us) AS last_us FROM s GROUP BY 1, 2)
        SELECT stream_index, segment, packets, rendition, bps * (last_us - start_us) // 8000000 AS bytes FROM g, {LADDER}""",
)
def _(spark, d):
    return recipes.ladder(packets(spark, d), RENDITIONS, DAY).select("stream_index", "segment", "packets", "rendition", "bytes")


@query(
    "ladder_playlists",
    f"""SELECT stream_index AS asset_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || (bps + 128000) * 11 // 10 || ',RESOLUTION=' || width || 'x' || height || chr(10) || rendition || '/index.m3u8' || chr(10), '' ORDER BY bps) AS playlist
        FROM (SELECT stream_index FROM ({STREAMS}) WHERE kind = 'video') s, (SELECT rendition, r.width, r.height, bps FROM {LADDER}) v GROUP BY 1""",
)
def _(spark, d):
    return recipes.ladder_playlists(streams(spark, d).where("kind = 'video'"), RENDITIONS)


@query(
    "concatenated",
    f"""WITH p AS (SELECT stream_index AS asset_id, seq % 4 AS part, seq, pts_us - {AT - 30 * DAY} AS pts_us FROM ({PACKETS})), n AS (SELECT asset_id, part, max(pts_us) AS duration_us FROM p GROUP BY 1, 2),
        o AS (SELECT *, coalesce(CAST(sum(duration_us) OVER (PARTITION BY asset_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM n)
        SELECT asset_id, seq, pts_us + before AS out_us FROM p JOIN o USING (asset_id, part)""",
)
def _(spark, d):
    p = packets(spark, d).select(F.col("stream_index").alias("asset_id"), (F.col("seq") % 4).alias("part"), "seq", (F.col("pts_us") - (AT - 30 * DAY)).alias("pts_us"))
    parts = p.groupBy("asset_id", "part").agg(F.max("pts_us").alias("duration_us"))
    return recipes.concatenated(p, parts).select("asset_id", "seq", "out_us")


@query(
    "negotiated_formats",
    f"""SELECT stream_index, CASE WHEN stream_index % 3 = 0 THEN CASE WHEN stream_index % 2 = 0 THEN 'yuv420p' ELSE '' END ELSE 'yuv420p,rgb24' END AS formats FROM ({STREAMS})""",
)
def _(spark, d):
    asked = F.when(F.col("stream_index") % 3 == 0, F.when(F.col("stream_index") % 2 == 0, "yuv420p").otherwise("gray10"))
    offer = F.array(F.lit("yuv420p"), F.lit("nv12"), F.lit("rgb24"))
    return streams(spark, d).select("stream_index", F.array_join(recipes.negotiated(offer, asked, ["rgb24", "yuv420p", "gray"]), ",").alias("formats"))


@query("colour_policy", f"SELECT stream_index, CASE WHEN stream_index % 2 = 0 THEN 'bt2020nc' WHEN height >= 720 THEN 'bt709' ELSE 'bt601' END AS guess, CASE WHEN stream_index % 2 = 0 THEN 'bt2020nc' END AS tagged, 'bt709' AS forced FROM ({STREAMS}) WHERE height IS NOT NULL")
def _(spark, d):
    space, h = F.when(F.col("stream_index") % 2 == 0, "bt2020nc").otherwise("unspecified"), F.col("height")
    return streams(spark, d).where("height is not null").select("stream_index", *[recipes.colour_tags(space, h, p, "bt709").alias(n) for n, p in (("guess", "guess"), ("tagged", "tagged"), ("forced", "force"))])


@query("rotations", "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 4 * 90 AS INTEGER) AS degrees FROM lineitem")
def _(spark, d):
    """Quarter turns by the part, at a scale by the quantity, which changes no angle."""
    k, scale = F.col("l_partkey") % 4, F.col("l_quantity").cast("int") * 1_000
    one = lambda a, b, c, e: F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(e) * scale
    angle = recipes.rotation_degrees(one(1, 0, -1, 0), one(0, 1, 0, -1), one(0, -1, 0, 1), one(1, 0, -1, 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", angle.alias("degrees"))


@query(
    "thumbnails",
    f"""WITH s AS (SELECT stream_index, min(pts_us) AS p0, max(pts_us) AS p1 FROM ({PACKETS}) GROUP BY 1), t AS (SELECT stream_index, q AS percent, p0 + CAST(trunc((p1 - p0) * q / 100) AS BIGINT) AS at_us FROM s, (VALUES (0.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) v(q))
        SELECT t.stream_index, percent, arg_min(seq, (pts_us, seq)) AS seq, min(pts_us) AS pts_us FROM t JOIN ({PACKETS}) p ON p.stream_index = t.stream_index AND pts_us >= at_us GROUP BY 1, 2""",
)
def _(spark, d):
    return recipes.thumbnails(packets(spark, d), [0, 25, 50])


@query(
    "frame_events",
    f"""SELECT stream_index, seq, 'scene' AS kind, CASE WHEN seq % 2 = 0 THEN measure ELSE 0.0 END AS value FROM ({PACKETS}) WHERE seq % 3 = 0
        UNION ALL SELECT stream_index, seq, 'crop', (size * 4)::DOUBLE FROM ({PACKETS}) WHERE seq % 5 = 0
        UNION ALL SELECT stream_index, seq, 'loudness', CASE WHEN seq % 4 = 0 THEN measure END FROM ({PACKETS}) WHERE seq % 4 IN (0, 1)""",
)
def _(spark, d):
    p, s = packets(spark, d), F.col("seq")
    pair = lambda when, key, v: F.when(when, F.struct(F.lit(key).alias("key"), v.cast("string").alias("value")))
    five = s % 5 == 0
    pairs = F.array(
        pair(s % 3 == 0, "scene.time", F.col("pts_us")), pair((s % 3 == 0) & (s % 2 == 0), "scene.score", F.col("measure")),
        pair(five, "crop.x", F.lit(0)), pair(five, "crop.y", F.lit(0)), pair(five, "crop.w", F.col("size")), pair(five | (s % 7 == 0), "crop.h", F.lit(4)),
        pair(s % 4 == 0, "loudness.integrated", F.col("measure")), pair(s % 4 == 1, "loudness.range", F.col("measure")),
    )
    return recipes.frame_events(p.withColumn("metadata", F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))))


@query("pipeline_of_frames", f"SELECT stream_index, seq FROM (SELECT *, row_number() OVER ({W}) AS n FROM ({PACKETS}) WHERE NOT is_corrupt) WHERE (n - 1) % 5 = 0")
def _(spark, d):
    from kinoframe.operators import sampling, scan

    return recipes.chained(packets(spark, d), scan.without_corrupt, lambda f: sampling.every_nth(f, 5)).select("stream_index", "seq")
