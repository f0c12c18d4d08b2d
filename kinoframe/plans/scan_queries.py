"""Queries over packet inspection, sampling and groups of pictures, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinoframe.functions import rational as R
from kinoframe.operators import gop, sampling, scan
from kinoframe.sources.tables import LINES, PACKETS, STREAMS, TYPED, line_packets, packets, streams, typed_packets

DAY = 86_400_000_000
#: A time inside the range of the events.
AT = 1_705_000_000_000_000

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    """Registers a query under its name, with its SQL."""

    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


W = "PARTITION BY stream_index ORDER BY seq"
UPTO = f"({W} ROWS UNBOUNDED PRECEDING)"
BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
STATS = """stream_index, count(*) AS packets, count(*) FILTER (is_key) AS keyframes, CAST(sum(size) AS BIGINT) AS bytes,
           min(pts_us) AS min_pts_us, max(pts_us) AS max_pts_us"""


def grid(source: str, step: int) -> str:
    return f"""
        SELECT * FROM (SELECT *, max(bucket) OVER {BEFORE} AS before FROM (
            SELECT *, (pts_us - first_value(pts_us) OVER {UPTO}) // {step} AS bucket FROM ({source})))
        WHERE before IS NULL OR bucket > before"""


@query("packet_stats", f"SELECT {STATS} FROM ({PACKETS}) GROUP BY 1")
def _(spark, d):
    return scan.packet_stats(packets(spark, d))


@query("line_packet_stats", f"SELECT {STATS} FROM ({LINES}) GROUP BY 1")
def _(spark, d):
    return scan.packet_stats(line_packets(spark, d))


@query("sampled_packet_stats", f"SELECT {STATS} FROM ({grid(PACKETS, DAY)}) GROUP BY 1")
def _(spark, d):
    return sampling.sampled_packet_stats(packets(spark, d), 86_400)


@query("sampled_line_stats", f"SELECT {STATS} FROM ({grid(LINES, 7 * DAY)}) GROUP BY 1")
def _(spark, d):
    return sampling.sampled_packet_stats(line_packets(spark, d), 7 * 86_400)


@query("stream_durations", f"SELECT stream_index, max(pts_us) + 40000 - min(pts_us) AS duration_us FROM ({PACKETS}) GROUP BY 1")
def _(spark, d):
    return scan.durations(packets(spark, d), 40_000)


@query(
    "seek_floor",
    f"""WITH p AS ({PACKETS}), f AS (SELECT stream_index, coalesce(max(pts_us) FILTER (is_key AND pts_us <= {AT}), min(pts_us)) AS floor_us FROM p GROUP BY 1)
        SELECT stream_index, seq, pts_us, pts_us - floor_us AS out_us FROM p JOIN f USING (stream_index) WHERE pts_us >= floor_us""",
)
def _(spark, d):
    return scan.seek_floor(packets(spark, d), AT).select("stream_index", "seq", "pts_us", "out_us")


@query("first_keyframe", f"SELECT stream_index, min(seq) AS seq, arg_min(pts_us, seq) AS pts_us FROM ({PACKETS}) WHERE is_key GROUP BY 1")
def _(spark, d):
    return scan.first_keyframe(packets(spark, d))


@query("trimmed", f"SELECT stream_index, seq, pts_us - {AT} AS out_us FROM ({PACKETS}) WHERE pts_us >= {AT} AND pts_us < {AT + 3 * DAY}")
def _(spark, d):
    return scan.trimmed(packets(spark, d), AT, 3 * DAY).select("stream_index", "seq", "out_us")


@query("trimmed_to_stop", f"SELECT stream_index, seq, pts_us - {AT} AS out_us FROM ({PACKETS}) WHERE pts_us >= {AT} AND pts_us < {AT + DAY}")
def _(spark, d):
    return scan.trimmed(packets(spark, d), AT, 3 * DAY, stop_us=AT + DAY).select("stream_index", "seq", "out_us")


@query(
    "stream_loop",
    f"""WITH p AS ({PACKETS}), s AS (SELECT stream_index, max(pts_us) - min(pts_us) AS span FROM p GROUP BY 1)
        SELECT stream_index, seq, CAST(k AS INTEGER) AS pass, pts_us + k * span AS out_us FROM p JOIN s USING (stream_index), range(3) t(k)""",
)
def _(spark, d):
    return scan.looped(packets(spark, d), 2).select("stream_index", "seq", "pass", "out_us")


@query("ts_scale", f"SELECT stream_index, seq, CAST(trunc(pts_us * 0.5::DOUBLE) AS BIGINT) AS out_us FROM ({PACKETS})")
def _(spark, d):
    return scan.rescaled(packets(spark, d), 0.5).select("stream_index", "seq", "out_us")


@query("forced_rate", f"SELECT stream_index, seq, row_number() OVER ({W}) - 1 AS tick, ((row_number() OVER ({W}) - 1) * 1001000000) // 30000 AS out_us FROM ({PACKETS})")
def _(spark, d):
    return scan.forced_rate(packets(spark, d), 30_000, 1001).select("stream_index", "seq", "tick", "out_us")


@query("paced", f"SELECT stream_index, seq, greatest(0, CAST(trunc((pts_us - min(pts_us) OVER (PARTITION BY stream_index) - 500000) / 2.0::DOUBLE) AS BIGINT)) AS due_us FROM ({PACKETS})")
def _(spark, d):
    return scan.paced(packets(spark, d), 2.0).select("stream_index", "seq", "due_us")


@query("without_corrupt", f"SELECT stream_index, count(*) AS packets FROM ({PACKETS}) WHERE NOT is_corrupt GROUP BY 1")
def _(spark, d):
    return scan.without_corrupt(packets(spark, d)).groupBy("stream_index").agg(F.count(F.lit(1)).alias("packets"))


@query(
    "decode_error_budget",
    f"""WITH g AS (SELECT *, sum(CASE WHEN is_corrupt THEN 0 ELSE 1 END) OVER {UPTO} AS good FROM ({PACKETS})),
        r AS (SELECT *, CAST(sum(is_corrupt::INT) OVER (PARTITION BY stream_index, good ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors_in_row FROM g),
        s AS (SELECT *, max((errors_in_row > 2)::INT) OVER {UPTO} AS stop FROM r)
        SELECT stream_index, seq, errors_in_row FROM s WHERE stop = 0""",
)
def _(spark, d):
    return scan.error_runs(packets(spark, d), 2).select("stream_index", "seq", "errors_in_row")


@query(
    "stream_copy_window",
    f"""WITH i AS (SELECT * FROM ({PACKETS}) WHERE pts_us >= {AT} AND pts_us < {AT + 7 * DAY}), k AS (SELECT *, max(is_key::INT) OVER {UPTO} AS keyed FROM i)
        SELECT stream_index, seq, pts_us - {AT} AS out_us FROM k WHERE keyed = 1""",
)
def _(spark, d):
    return scan.copy_window(packets(spark, d), AT, 7 * DAY).select("stream_index", "seq", "out_us")


@query("keep_media", f"SELECT kind, count(*) AS streams FROM ({STREAMS}) WHERE kind <> 'subtitle' GROUP BY 1")
def _(spark, d):
    return scan.keep_media(streams(spark, d), subtitle=False).groupBy("kind").agg(F.count(F.lit(1)).alias("streams"))


@query("limit_each_stream", f"SELECT stream_index, seq FROM (SELECT *, row_number() OVER ({W}) AS n FROM ({PACKETS})) WHERE n <= 5")
def _(spark, d):
    return scan.limit_each(packets(spark, d), 5).select("stream_index", "seq")


@query("every_nth", f"SELECT stream_index, seq FROM (SELECT *, row_number() OVER ({W}) AS n FROM ({PACKETS})) WHERE (n - 1) % 7 = 0")
def _(spark, d):
    return sampling.every_nth(packets(spark, d), 7).select("stream_index", "seq")


@query("every_sec", f"SELECT stream_index, seq, bucket FROM ({grid(PACKETS, DAY)})")
def _(spark, d):
    return sampling.every_sec(packets(spark, d), 86_400).select("stream_index", "seq", "bucket")


@query("keyframes_only", f"SELECT stream_index, seq FROM ({PACKETS}) WHERE is_key")
def _(spark, d):
    return sampling.keyframes_only(packets(spark, d)).select("stream_index", "seq")


@query(
    "uniform_n",
    f"""WITH p AS ({PACKETS}), s AS (SELECT stream_index, min(pts_us) AS p0, max(pts_us) - min(pts_us) AS span FROM p GROUP BY 1),
        t AS (SELECT stream_index, CAST(i AS INTEGER) AS target, 2 * 16 * p0::HUGEINT + (2 * i + 1) * span AS at FROM s, range(16) r(i))
        SELECT t.stream_index, t.target, max(p.seq) AS seq FROM t JOIN p ON p.stream_index = t.stream_index AND 2 * 16 * p.pts_us::HUGEINT <= t.at GROUP BY 1, 2""",
)
def _(spark, d):
    return sampling.uniform_n(packets(spark, d), 16).select("stream_index", F.col("target").cast("int").alias("target"), "seq")


@query("tumbling_segments", f"SELECT stream_index, (pts_us - p0) // {DAY} AS segment, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT *, min(pts_us) OVER (PARTITION BY stream_index) AS p0 FROM ({PACKETS})) GROUP BY 1, 2")
def _(spark, d):
    return sampling.tumbling(packets(spark, d), DAY)


@query("key_segments", f"SELECT stream_index, seq, max(cell) OVER {UPTO} AS segment FROM (SELECT *, CASE WHEN is_key THEN (pts_us - min(pts_us) OVER (PARTITION BY stream_index)) // {DAY} ELSE 0 END AS cell FROM ({PACKETS}))")
def _(spark, d):
    return sampling.key_segments(packets(spark, d), DAY).select("stream_index", "seq", "segment")


@query(
    "thumbnail_at_time",
    f"WITH p AS (SELECT *, min(pts_us) OVER (PARTITION BY stream_index) AS p0 FROM ({PACKETS})) SELECT stream_index, min(pts_us) AS pts_us, arg_min(seq, (pts_us, seq)) AS seq FROM p WHERE pts_us - p0 >= {2 * DAY} GROUP BY 1",
)
def _(spark, d):
    return sampling.at_time(packets(spark, d), 2 * DAY)


@query("thumbnail_at_index", f"SELECT stream_index, seq FROM (SELECT *, row_number() OVER ({W}) AS n FROM ({PACKETS})) WHERE n = 11")
def _(spark, d):
    return sampling.at_index(packets(spark, d), 10).select("stream_index", "seq")


@query(
    "sprite_cells",
    f"""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER ({W}) AS r FROM ({PACKETS})) WHERE (r - 1) % 3 = 0), n AS (SELECT stream_index, seq, row_number() OVER ({W}) - 1 AS n FROM k)
        SELECT stream_index, seq, n // 12 AS sheet, (n % 12) // 4 AS row, n % 4 AS col FROM n""",
)
def _(spark, d):
    return sampling.sprite_cells(packets(spark, d), 4, 3, 3)


GOP = f"(SELECT *, CAST(sum(opens) OVER {UPTO} AS BIGINT) AS gop_id FROM (SELECT *, CASE WHEN is_key AND row_number() OVER ({W}) > 1 THEN 1 ELSE 0 END AS opens FROM ({PACKETS})))"
GOP_STATS = f"(SELECT stream_index, gop_id, count(*) AS frames, CAST(sum(size) AS BIGINT) AS bytes, bool_or(is_key) AS has_key FROM {GOP} GROUP BY 1, 2)"


@query("gop_stats", f"SELECT * FROM {GOP_STATS}")
def _(spark, d):
    return gop.gop_stats(packets(spark, d))


@query("gop_retained", f"SELECT stream_index, seq, gop_id FROM (SELECT *, max(gop_id) OVER (PARTITION BY stream_index) AS last FROM {GOP}) WHERE gop_id >= last - 2")
def _(spark, d):
    return gop.retained(packets(spark, d), 2).select("stream_index", "seq", "gop_id")


@query("gop_replay_suffix", f"SELECT stream_index, gop_id, suffix_bytes FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY stream_index ORDER BY gop_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS suffix_bytes FROM {GOP_STATS}) WHERE suffix_bytes <= 600")
def _(spark, d):
    return gop.replay_suffix(packets(spark, d), 600).select("stream_index", "gop_id", "suffix_bytes")


@query("gop_gated", f"SELECT stream_index, seq FROM (SELECT *, max(is_key::INT) OVER {UPTO} AS seen FROM ({TYPED})) WHERE seen = 1")
def _(spark, d):
    return gop.gated(typed_packets(spark, d)).select("stream_index", "seq")


@query("gop_bounded", f"SELECT stream_index, seq, gop_id FROM (SELECT *, count(*) OVER (PARTITION BY stream_index, gop_id) AS n, row_number() OVER (PARTITION BY stream_index, gop_id ORDER BY seq) - 1 AS place FROM {GOP}) WHERE place >= n - n % 4")
def _(spark, d):
    return gop.bounded(packets(spark, d), 3).select("stream_index", "seq", "gop_id")


@query("serving_prefix", f"SELECT stream_index, seq, coalesce(CAST(sum(size) OVER {BEFORE} AS BIGINT), 0) AS ahead_bytes FROM ({PACKETS})")
def _(spark, d):
    return gop.serving_prefix(packets(spark, d)).select("stream_index", "seq", "ahead_bytes")


@query("rescale_q", f"SELECT seq, CASE WHEN pts_us - {AT} < 0 THEN -((2 * abs((pts_us - {AT})::HUGEINT) * 90000 + 1000000) // 2000000) ELSE (2 * (pts_us - {AT})::HUGEINT * 90000 + 1000000) // 2000000 END::BIGINT AS ticks FROM ({PACKETS})")
def _(spark, d):
    return packets(spark, d).select("seq", R.rescale_q(F.col("pts_us") - AT, 1, 1_000_000, 1, 90_000).alias("ticks"))


@query("compare_ts", f"SELECT seq, CASE WHEN pts_us::HUGEINT * 3 < ({AT} // 1000000 * 3000000)::HUGEINT THEN -1 WHEN pts_us::HUGEINT * 3 > ({AT} // 1000000 * 3000000)::HUGEINT THEN 1 ELSE 0 END AS sign FROM ({PACKETS})")
def _(spark, d):
    return packets(spark, d).select("seq", R.compare_ts(F.col("pts_us"), 1, 1_000_000, F.lit(AT // 1_000_000 * 3), 1, 3).alias("sign"))


@query("median3_clamp", f"SELECT seq, greatest(least(size, 50), least(greatest(size, 50), seq)) AS med, greatest(10, least(40, size)) AS clamped FROM ({PACKETS})")
def _(spark, d):
    return packets(spark, d).select("seq", R.median3(F.col("size"), F.lit(50), F.col("seq")).alias("med"), R.clamp(F.col("size"), F.lit(10), F.lit(40)).cast("long").alias("clamped"))


@query("secs_to_us", f"SELECT seq, CAST(round(measure * 1000000::DOUBLE) AS BIGINT) AS us FROM ({PACKETS})")
def _(spark, d):
    return packets(spark, d).select("seq", R.secs_to_us(F.col("measure")).alias("us"))
