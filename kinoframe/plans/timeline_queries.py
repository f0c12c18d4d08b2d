"""Queries over timestamp repair, cuts, progress, detector events and colour routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinoframe.operators import analysis, mux, timeline
from kinoframe.plans.scan_queries import AT, BEFORE, DAY, UPTO, W
from kinoframe.sources.tables import CHUNKS, PACKETS, STREAMS, TYPED, chunks, packets, streams, typed_packets

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return add


def stamped(spark, d):
    """Packets with decoding stamps out of order, a seventh of them without a dts and an eleventh without a pts."""
    base, seq = packets(spark, d), F.col("seq")
    base = base.withColumn("pts", F.when(seq % 11 != 5, F.call_function("div", F.col("pts_us"), F.lit(1_000_000))))
    dts = F.call_function("div", F.col("pts_us"), F.lit(1_000_000)) + F.pmod(seq * 7919, F.lit(40_000)) - 20_000
    return base.withColumn("dts", F.when(seq % 7 != 3, dts))


STAMPED = f"""SELECT *, CASE WHEN seq % 11 <> 5 THEN pts_us // 1000000 END AS pts,
        CASE WHEN seq % 7 <> 3 THEN pts_us // 1000000 + (seq * 7919) % 40000 - 20000 END AS dts FROM ({PACKETS})"""
#: Runs between packets without dts.
RUNS = f"SELECT *, count(*) FILTER (dts IS NULL) OVER {UPTO} AS run FROM ({STAMPED})"
RUN = "PARTITION BY stream_index, run ORDER BY seq"


def monotone_sql(top: str) -> str:
    """The greatest so far of a run, of dts less rank or of dts."""
    return f"""SELECT stream_index, seq, out_dts, CASE WHEN pts IS NOT NULL THEN greatest(pts, out_dts) END AS out_pts FROM (
        SELECT *, CASE WHEN dts IS NOT NULL THEN {top} END AS out_dts FROM (SELECT *, row_number() OVER ({RUN}) AS r FROM ({RUNS})))"""


@query("dts_strict", monotone_sql(f"max(dts - r) OVER ({RUN} ROWS UNBOUNDED PRECEDING) + r"))
def _(spark, d):
    return timeline.monotone_dts(stamped(spark, d)).select("stream_index", "seq", "out_dts", "out_pts")


@query("dts_non_strict", monotone_sql(f"max(dts) OVER ({RUN} ROWS UNBOUNDED PRECEDING)"))
def _(spark, d):
    return timeline.monotone_dts(stamped(spark, d), strict=False).select("stream_index", "seq", "out_dts", "out_pts")


def written_sql(least: str | None) -> str:
    """The writer's loop: a dts after its pts is guessed, then one that lies before ``least`` is moved there; ``last`` is what was
    written before."""
    late = f"last IS NOT NULL AND g < {least}" if least else "false"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT stream_index, seq, pts, dts, row_number() OVER ({W}) AS r FROM ({STAMPED})), f AS (
        SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, NULL::BIGINT AS out_pts, NULL::BIGINT AS last FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT stream_index, r, seq, CASE WHEN {late} AND q >= g THEN greatest(q, {least or 'q'}) ELSE q END, CASE WHEN {late} THEN {least or 'g'} ELSE g END FROM (
            SELECT stream_index, r, seq, last, CASE WHEN wrong THEN guess ELSE dts END AS g, CASE WHEN wrong THEN guess ELSE pts END AS q FROM (
                SELECT p.*, f.last, coalesce(p.dts > p.pts, false) AS wrong, CASE WHEN f.last IS NULL THEN p.pts ELSE greatest(p.pts, least(p.dts, f.last + 1)) END AS guess
                FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)))
        SELECT stream_index, seq, out_pts, last AS out_dts FROM f WHERE r > 0"""


@query("dts_guess", written_sql(None))
def _(spark, d):
    return timeline.guessed_dts(stamped(spark, d), cell=2_500).select("stream_index", "seq", "out_pts", "out_dts")


def written(spark, d, kind, strict):
    one = lambda n: F.lit(n).cast("int")
    rows = stamped(spark, d).withColumn("kind", F.lit(kind)).withColumn("copied", F.lit(False)).withColumn("duration", F.col("size"))
    rows = rows.withColumns({"num": one(1), "den": one(1), "sample_rate": one(None), "samples": one(None), "out_num": one(1), "out_den": one(1)})
    return mux.muxed(rows, strict, cell=2_500).select("stream_index", "seq", "out_pts", "out_dts")


@query("mux_strict", written_sql("last + 1"))
def _(spark, d):
    return written(spark, d, "video", True)


@query("mux_lenient", written_sql("last"))
def _(spark, d):
    return written(spark, d, "audio", False)


@query("mux_data", written_sql(None))
def _(spark, d):
    return written(spark, d, "data", True)


# sound of 1024 samples a packet at 44100 Hz, stamped in milliseconds with what a size adds, written in samples: the place that
# is due is taken where the stamp allows it
@query(
    "mux_sound",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT stream_index, seq, r, ms, floor(floor(((2 * ms - 1) * 44100)::DOUBLE / 1000) / 2)::BIGINT AS low,
            floor((ceil(((2 * ms + 1) * 44100)::DOUBLE / 1000) + 1) / 2)::BIGINT AS high, round((ms * 44100)::DOUBLE / 1000)::BIGINT AS sure FROM (
            SELECT stream_index, seq, r, round((r * 1024000)::DOUBLE / 44100)::BIGINT + size % 3 AS ms FROM (SELECT *, row_number() OVER ({W}) AS r FROM ({PACKETS})))),
        f AS (SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, NULL::BIGINT AS due, 0::BIGINT AS place FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT stream_index, r, seq, place + 1024, place FROM (SELECT p.stream_index, p.r, p.seq, CASE WHEN f.due BETWEEN 2 * low - high AND 2 * high - low THEN least(greatest(f.due, low), high) ELSE sure END AS place
            FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)),
        s AS (SELECT *, lag(out_dts) OVER ({W}) AS before FROM (SELECT stream_index, seq, place AS out_dts FROM f WHERE r > 0))
        SELECT stream_index, seq, CAST(max(out_dts - n) OVER (PARTITION BY stream_index ORDER BY seq ROWS UNBOUNDED PRECEDING) + n AS BIGINT) AS out_dts FROM (SELECT *, row_number() OVER ({W}) AS n FROM s)""",
)
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("stream_index").orderBy("seq")).cast("long")
    ms = F.round((r * 1_024_000) / F.lit(44_100.0)).cast("long") + F.col("size") % 3
    one = lambda n: F.lit(n).cast("int")
    rows = packets(spark, d).select("stream_index", "seq", F.lit("audio").alias("kind"), F.lit(True).alias("copied"), ms.alias("pts"), ms.alias("dts"), F.lit(23).cast("long").alias("duration"))
    rows = rows.withColumns({"num": one(1), "den": one(1_000), "sample_rate": one(44_100), "samples": one(1_024), "out_num": one(1), "out_den": one(44_100)})
    return mux.muxed(rows, cell=2_500).select("stream_index", "seq", "out_dts")


@query(
    "strict_sink_violations",
    f"""SELECT * FROM (SELECT stream_index, seq, pts < dts AS late_pts, coalesce(dts <= lag(dts) OVER ({W}), false) AS dts_back,
        row_number() OVER (PARTITION BY stream_index, pts ORDER BY seq) > 1 AS pts_again FROM ({STAMPED})) WHERE late_pts OR dts_back OR pts_again""",
)
def _(spark, d):
    return timeline.violations(stamped(spark, d)).select("stream_index", "seq", "late_pts", "dts_back", "pts_again")


@query(
    "discontinuities",
    f"""WITH j AS (SELECT stream_index, seq, pts_us, CASE WHEN pts_us - lag(pts_us) OVER ({W}) > {DAY} THEN pts_us - lag(pts_us) OVER ({W}) ELSE 0 END AS jump_us FROM ({PACKETS}))
        SELECT stream_index, seq, coalesce(jump_us, 0) AS jump_us, -CAST(sum(coalesce(jump_us, 0)) OVER {UPTO} AS BIGINT) AS offset_us FROM j""",
)
def _(spark, d):
    return timeline.discontinuities(packets(spark, d), forward_us=DAY).select("stream_index", "seq", "jump_us", "offset_us")


@query("start_offsets", f"SELECT stream_index, seq, pts_us - min(pts_us) OVER (PARTITION BY asset_id) AS out_us FROM ({PACKETS})")
def _(spark, d):
    return timeline.start_offsets(packets(spark, d)).select("stream_index", "seq", "out_us")


def gappy(spark, d):
    return packets(spark, d).withColumn("pts_us", F.when(F.col("seq") % 3 != 0, F.col("pts_us")))


GAPPY = f"SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN pts_us END AS pts_us) FROM ({PACKETS})"


@query(
    "filled_pts",
    f"""WITH a AS (SELECT *, last_value(pts_us IGNORE NULLS) OVER {UPTO} AS known, last_value(pts_us IGNORE NULLS) OVER {BEFORE} AS prev,
             count(pts_us) OVER {UPTO} AS island FROM ({GAPPY})),
        b AS (SELECT *, CASE WHEN pts_us IS NOT NULL THEN pts_us - prev END AS delta FROM a),
        c AS (SELECT *, greatest(coalesce(last_value(delta IGNORE NULLS) OVER {UPTO}, 1), 1) AS step, row_number() OVER (PARTITION BY stream_index, island ORDER BY seq) AS run FROM b)
        SELECT stream_index, seq, CASE WHEN pts_us IS NOT NULL THEN pts_us WHEN known IS NULL THEN run - 1 ELSE known + (run - 1) * step END AS out_us FROM c""",
)
def _(spark, d):
    return timeline.filled_pts(gappy(spark, d)).select("stream_index", "seq", "out_us")


BASES = [(0, 1, 25), (1, 1, 44_100), (2, 1, 90_000), (3, 1001, 30_000), (4, 1, 1_000)]


@query(
    "shared_origin",
    f"""WITH b(stream_index, num, den) AS (VALUES {", ".join(str(x) for x in BASES)}), p AS (SELECT t.*, b.num, b.den, seq * 3 + 5 AS dts FROM ({TYPED}) t JOIN b USING (stream_index)),
        o AS (SELECT dts::HUGEINT AS o_dts, num AS o_num, den AS o_den FROM p ORDER BY seq LIMIT 1)
        SELECT stream_index, seq, dts - CAST((2 * o_dts * o_num * den + o_den * num) // (2 * o_den * num) AS BIGINT) AS out_dts FROM p, o""",
)
def _(spark, d):
    bases = spark.createDataFrame(BASES, "stream_index long, num int, den int")
    rows = typed_packets(spark, d).withColumn("dts", F.col("seq") * 3 + 5)
    return timeline.shared_origin(rows, bases).select("stream_index", "seq", "out_dts")


# an asset a tenth of the users, a stream an event type; a seventh of the packets has no stamp, and one lies a century off
QUEUED = f"""SELECT user_id % 10 AS asset_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS BIGINT) AS stream_index,
        event_id AS seq, CASE WHEN event_id % 7 <> 2 THEN epoch_us(ts) // 60000000 + length(props) + CASE WHEN event_id = 100 THEN 52560000 ELSE 0 END END AS dts FROM events"""


def queued(spark, d):
    kind = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END").cast("long")
    far = F.when(F.col("seq") == 100, 52_560_000).otherwise(0)
    dts = F.call_function("div", F.col("pts_us"), F.lit(60_000_000)) + F.col("size") + far
    return packets(spark, d).select((F.col("stream_index") % 10).alias("asset_id"), kind.alias("stream_index"), "seq", F.when(F.col("seq") % 7 != 2, dts).alias("dts"))


@query(
    "interleaved",
    f"""SELECT asset_id, stream_index, seq, row_number() OVER (PARTITION BY asset_id ORDER BY place NULLS FIRST, stream_index, seq) AS position FROM (
        SELECT *, last_value(dts IGNORE NULLS) OVER (PARTITION BY asset_id, stream_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS place FROM ({QUEUED}))""",
)
def _(spark, d):
    return timeline.interleaved(queued(spark, d), cell=2_500).select("asset_id", "stream_index", "seq", "position")


# a packet needs the head to come as far as its stream has; the head is the least of the limiting streams
@query(
    "released",
    f"""WITH q AS (SELECT *, (dts * 1000 * den // 1000) AS e FROM (SELECT *, 1000::BIGINT AS den FROM ({QUEUED}))),
        n AS (SELECT *, max(e) OVER (PARTITION BY asset_id, stream_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS need,
            max(e) FILTER (stream_index = 1) OVER a AS h1, max(e) FILTER (stream_index = 3) OVER a AS h3 FROM q WINDOW a AS (PARTITION BY asset_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT asset_id, least(h1, h3) AS head, min(seq) AS since FROM n WHERE h1 IS NOT NULL AND h3 IS NOT NULL GROUP BY ALL),
        g AS (SELECT n.asset_id, n.stream_index, n.seq, CASE WHEN n.need IS NULL THEN n.seq ELSE greatest(n.seq, (SELECT min(since) FROM h WHERE h.asset_id = n.asset_id AND h.head >= n.need)) END AS goes, n.need FROM n)
        SELECT asset_id, stream_index, seq, row_number() OVER (PARTITION BY asset_id ORDER BY goes, stream_index, seq) AS position
        FROM g JOIN (SELECT asset_id AS a, max(head) AS most FROM h GROUP BY 1) ON a = asset_id WHERE need IS NULL OR need <= most""",
)
def _(spark, d):
    # the same length of time in ticks of different bases
    rows = queued(spark, d).withColumn("den", F.when(F.col("stream_index") % 2 == 0, 500).otherwise(1_000)).withColumn("num", F.lit(1))
    rows = rows.withColumn("end", F.when(F.col("stream_index") % 2 == 0, F.col("dts") * 500).otherwise(F.col("dts") * 1_000))
    return timeline.released(rows, [1, 3], cell=2_500).select("asset_id", "stream_index", "seq", "position")


@query("frame_ends", f"""SELECT stream_index, seq, pts + CASE WHEN seq % 3 <> 0 THEN (2 * (size * 100) * 90000 + 44100) // (2 * 44100) ELSE size END AS "end" FROM ({STAMPED})""")
def _(spark, d):
    seq, size = F.col("seq"), F.col("size")
    rows = stamped(spark, d).withColumns({"num": F.lit(1), "den": F.lit(90_000), "sample_rate": F.lit(44_100), "samples": F.when(seq % 3 != 0, size * 100), "duration": size})
    return timeline.ends(rows).select("stream_index", "seq", "end")


ENDED = f"SELECT *, (dts * 60000000 + 40000) AS end_us FROM ({QUEUED})"


@query(
    "shortest_cut",
    f"""WITH p AS ({ENDED}), c AS (SELECT asset_id, min(last) AS cut FROM (SELECT asset_id, stream_index, max(end_us) AS last FROM p WHERE stream_index IN (1, 3) GROUP BY ALL) GROUP BY 1),
        s AS (SELECT p.asset_id, p.stream_index, min(seq) AS stop FROM p JOIN c USING (asset_id) WHERE end_us > cut GROUP BY ALL)
        SELECT p.asset_id, p.stream_index, p.seq FROM p LEFT JOIN s ON p.asset_id = s.asset_id AND p.stream_index = s.stream_index WHERE stop IS NULL OR seq < stop""",
)
def _(spark, d):
    return timeline.shortest(queued(spark, d).withColumn("end_us", F.col("dts") * 60_000_000 + 40_000), [1, 3]).select("asset_id", "stream_index", "seq")


PROGRESS = f"""SELECT 0 AS asset_id, coalesce(min(mark) FILTER (stream_index IN (0, 2)), max(mark)) AS out_us, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS packets
        FROM (SELECT stream_index, max(pts_us) AS mark, sum(size) AS bytes, count(*) AS n FROM ({TYPED}) GROUP BY 1)"""


@query("progress_out_time", PROGRESS)
def _(spark, d):
    return timeline.progress(typed_packets(spark, d), [0, 2])


@query("progress_rates", f"SELECT asset_id, bytes * 8000 / (out_us - {AT - 30 * DAY})::DOUBLE AS kbps, (out_us - {AT - 30 * DAY}) / 1000000000.0::DOUBLE AS speed FROM ({PROGRESS})")
def _(spark, d):
    return timeline.rates(timeline.progress(typed_packets(spark, d), [0, 2]), AT - 30 * DAY, 1_000_000_000)


@query("progress_percent", f"SELECT asset_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, (out_us - {AT}) * 100.0::DOUBLE / {90 * DAY})) AS percent FROM ({PROGRESS})")
def _(spark, d):
    return timeline.progress(typed_packets(spark, d), [0, 2]).select("asset_id", timeline.percent(F.col("out_us") - AT, 90 * DAY).alias("percent"))


# --- detector events ---

ISLANDS = f"""SELECT stream_index, start_us, end_us FROM (
        SELECT stream_index, min(pts_us) AS start_us, max(coalesce(next, pts_us + 40000)) AS end_us FROM (
            SELECT *, measure < {{limit}} AS hit, lead(pts_us) OVER ({W}) AS next, sum(CASE WHEN measure < {{limit}} THEN 0 ELSE 1 END) OVER {UPTO} AS run FROM ({PACKETS}))
        WHERE hit GROUP BY stream_index, run) WHERE end_us - start_us >= {{least}}"""


def dark(spark, d, limit=40.0, least=DAY):
    return analysis.islands(packets(spark, d), F.col("measure") < limit, least, 40_000)


@query("black_ranges", ISLANDS.format(limit=40.0, least=DAY))
def _(spark, d):
    return dark(spark, d)


@query("silence_ranges", ISLANDS.format(limit=20.0, least=1000))
def _(spark, d):
    return dark(spark, d, 20.0, 1000)


SCENES = f"SELECT stream_index, pts_us AS at_us, score FROM (SELECT *, abs(measure - lag(measure) OVER ({W})) AS score FROM ({PACKETS})) WHERE score >= 60"


def cuts(spark, d):
    from kinoframe.operators.scan import ordered

    return analysis.scenes(packets(spark, d), F.abs(F.col("measure") - F.lag("measure").over(ordered())), 60.0)


@query("scene_changes", SCENES)
def _(spark, d):
    return cuts(spark, d)


@query(
    "analysis_report",
    f"""WITH a AS (SELECT stream_index, count(*) AS ranges, CAST(sum(end_us - start_us) AS BIGINT) AS ranges_us FROM ({ISLANDS.format(limit=40.0, least=DAY)}) GROUP BY 1),
        b AS (SELECT stream_index, count(*) AS scenes, max(score) AS best_score FROM ({SCENES}) GROUP BY 1)
        SELECT stream_index, coalesce(ranges, 0) AS ranges, coalesce(ranges_us, 0) AS ranges_us, coalesce(scenes, 0) AS scenes, best_score FROM a FULL JOIN b USING (stream_index)""",
)
def _(spark, d):
    return analysis.report(dark(spark, d), cuts(spark, d))


@query("last_loudness", f"SELECT stream_index, arg_max(a, seq) FILTER (a IS NOT NULL) AS integrated, arg_max(b, seq) FILTER (b IS NOT NULL) AS range FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN measure END AS a, CASE WHEN seq % 5 = 0 THEN measure / 2 END AS b FROM ({PACKETS})) GROUP BY 1")
def _(spark, d):
    p = packets(spark, d).withColumn("integrated", F.when(F.col("seq") % 3 == 0, F.col("measure"))).withColumn("range", F.when(F.col("seq") % 5 == 0, F.col("measure") / 2))
    return analysis.last_known(p, "integrated", "range")


@query("crop_last", f"SELECT stream_index, arg_max(size, seq) AS x, arg_max(size + 1, seq) AS y, arg_max(size * 2, seq) AS w, arg_max(size * 3, seq) AS h FROM ({PACKETS}) WHERE seq % 4 = 1 GROUP BY 1")
def _(spark, d):
    p = packets(spark, d)
    some = F.when(F.col("seq") % 4 == 1, F.col("size"))
    return analysis.crop(p.withColumn("x", some).withColumn("y", F.col("size") + 1).withColumn("w", F.col("size") * 2).withColumn("h", F.col("size") * 3))


COLOURS = f"""SELECT stream_index, height, CASE stream_index % 4 WHEN 0 THEN 'bt2020nc' WHEN 1 THEN 'bt709' END AS space,
        CASE stream_index % 5 WHEN 0 THEN 'smpte2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN 'bt709' END AS trc, CASE stream_index % 7 WHEN 0 THEN 'bt2020' ELSE 'bt709' END AS prim FROM ({STREAMS})"""


@query(
    "colour_routing",
    f"""SELECT stream_index, coalesce(space = 'bt2020nc', false) OR prim = 'bt2020' OR coalesce(trc IN ('smpte2084', 'arib-std-b67'), false) AS hdr,
        CASE WHEN height >= 720 THEN 'bt709' ELSE 'bt601' END AS guessed,
        CASE WHEN trc = 'smpte2084' THEN 'pq' WHEN trc = 'arib-std-b67' THEN 'hlg' WHEN coalesce(space = 'bt2020nc', false) OR prim = 'bt2020' THEN 'wide_gamut_sdr' ELSE 'sdr' END AS kind FROM ({COLOURS})""",
)
def _(spark, d):
    k = F.col("stream_index")
    space = F.when(k % 4 == 0, "bt2020nc").when(k % 4 == 1, "bt709")
    trc = F.when(k % 5 == 0, "smpte2084").when(k % 5 == 1, "arib-std-b67").when(k % 5 == 2, "bt709")
    prim = F.when(k % 7 == 0, "bt2020").otherwise("bt709")
    return streams(spark, d).select("stream_index", analysis.is_hdr(space, trc, prim).alias("hdr"), analysis.guessed_space(F.col("height")).alias("guessed"), analysis.colour_kind(space, trc, prim).alias("kind"))


LOUD = f'SELECT asset_id, "index", pts_us, list_max(list_transform(data, lambda x: abs(x::DOUBLE))) AS peak, round(list_sum(list_transform(data, lambda x: x::DOUBLE * x::DOUBLE)) / len(data), 9) AS mean_square FROM ({CHUNKS})'


@query("chunk_loudness", LOUD)
def _(spark, d):
    return analysis.loudness(chunks(spark, d)).withColumn("mean_square", F.round("mean_square", 9))


@query("sliding_loudness", f'SELECT asset_id, "index", round(avg(mean_square) OVER (PARTITION BY asset_id ORDER BY "index" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS window_mean FROM ({LOUD})')
def _(spark, d):
    return analysis.windowed_loudness(chunks(spark, d), 4).select("asset_id", "index", F.round("window_mean", 6).alias("window_mean"))
