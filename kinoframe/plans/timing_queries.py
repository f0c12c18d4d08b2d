"""Queries over the timing of packets and frames: predictions, durations, time bases, rate conversion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinoframe.operators import analysis, chain, frame_timing, intake, rate, timeline
from kinoframe.plans.scan_queries import AT, DAY, UPTO, W
from kinoframe.sources.tables import PACKETS, TYPED, packets, table, typed_packets

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        ORACLE[name] = sql
        return run

    return add


# --- stamps that are predicted ---

SPARSE = f"SELECT stream_index, seq, r, CASE WHEN seq % 4 <> 1 THEN pts_us END AS pts_us, CASE WHEN seq % 5 = 0 THEN pts_us END AS dts_us, CASE WHEN seq % 7 <> 0 THEN size * 1000 END AS duration_us FROM (SELECT *, row_number() OVER ({W}) AS r FROM ({PACKETS}))"


def sparse(spark, d):
    s = F.col("seq")
    return packets(spark, d).select("stream_index", "seq", F.when(s % 4 != 1, F.col("pts_us")).alias("pts_us"), F.when(s % 5 == 0, F.col("pts_us")).alias("dts_us"), F.when(s % 7 != 0, F.col("size") * 1000).alias("duration_us"))


# the loop itself: what a stream's next packet is expected at
@query(
    "predicted_dts",
    f"""WITH RECURSIVE p AS MATERIALIZED ({SPARSE}), f AS (
        SELECT stream_index, r, seq, coalesce(dts_us, coalesce(pts_us, 0) - 80000) AS out_us, coalesce(dts_us, coalesce(pts_us, 0) - 80000) + coalesce(duration_us, 0) AS next FROM p WHERE r = 1
        UNION ALL SELECT p.stream_index, p.r, p.seq, coalesce(p.dts_us, f.next), coalesce(p.dts_us, f.next) + coalesce(p.duration_us, 0) FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)
        SELECT stream_index, seq, out_us FROM f""",
)
def _(spark, d):
    return frame_timing.predicted_dts(sparse(spark, d), 80_000).select("stream_index", "seq", "out_us")


def nearest(x: str, n: int, d: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN -((2 * abs(({x})::HUGEINT) * {n} + {d}) // (2 * {d})) ELSE (2 * ({x})::HUGEINT * {n} + {d}) // (2 * {d}) END)::BIGINT"


NEXT = nearest(f"({nearest('o', 30000, 1001 * 1000000)} + 1)", 1001 * 1000000, 30000)


@query(
    "predicted_dts_at_rate",
    f"""WITH RECURSIVE p AS MATERIALIZED ({SPARSE}), f AS (
        SELECT stream_index, r, seq, coalesce(dts_us, coalesce(pts_us, 0)) AS o FROM p WHERE r = 1
        UNION ALL SELECT p.stream_index, p.r, p.seq, coalesce(p.dts_us, {NEXT}) FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)
        SELECT stream_index, seq, o AS out_us FROM f""",
)
def _(spark, d):
    return frame_timing.predicted_dts(sparse(spark, d), rate=(30_000, 1_001)).select("stream_index", "seq", "out_us")


GUESSED = f"SELECT stream_index, seq, r, CASE WHEN seq % 3 <> 0 THEN pts_us // 1000000 END AS pts, CASE WHEN seq % 4 = 0 THEN 1 WHEN seq % 4 = 1 THEN 0 ELSE size END AS duration FROM (SELECT *, row_number() OVER ({W}) AS r FROM ({PACKETS}))"


def shown_sql(steady: str) -> str:
    """A frame after the other: a missing stamp builds on the last estimate, and the next estimate on that stamp."""
    return f"""WITH RECURSIVE p AS MATERIALIZED ({GUESSED}), f AS (
        SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, NULL::BIGINT AS t, 0::BIGINT AS e FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT stream_index, r, seq, t, CASE WHEN duration > 0 AND NOT (duration = 1 AND step > 2) THEN duration WHEN step > 0 THEN step WHEN duration > 0 THEN duration ELSE {steady} END FROM (
            SELECT *, coalesce(t - t0, -1) AS step FROM (SELECT p.stream_index, p.r, p.seq, p.duration, f.t AS t0, f.e AS last, coalesce(p.pts, f.t + f.e, 0) AS t
                FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)))
        SELECT stream_index, seq, t AS out_pts, e AS estimate FROM f WHERE r > 0"""


def shown(spark, d):
    s = F.col("seq")
    pts = F.when(s % 3 != 0, F.call_function("div", F.col("pts_us"), F.lit(1_000_000)))
    return packets(spark, d).select("stream_index", "seq", pts.alias("pts"), F.when(s % 4 == 0, 1).when(s % 4 == 1, 0).otherwise(F.col("size")).alias("duration"))


@query("estimated_durations", shown_sql("greatest(last, 1)"))
def _(spark, d):
    return frame_timing.timed_frames(shown(spark, d), cell=2_500).select("stream_index", "seq", "out_pts", "estimate")


@query("estimated_durations_at_rate", shown_sql("40"))
def _(spark, d):
    return frame_timing.timed_frames(shown(spark, d), rate_ticks=40, stream_ticks=50, cell=2_500).select("stream_index", "seq", "out_pts", "estimate")


RATES = [44_100, 48_000, 22_050, 96_000, 11_025, 7_919, 32_000]


@query(
    "common_rates",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT stream_index, seq, rate, row_number() OVER (PARTITION BY stream_index ORDER BY seq) AS r FROM (
            SELECT *, lag(rate) OVER ({W}) AS before FROM (SELECT stream_index, seq, ({RATES})[(seq // 300) % 7 + 1] AS rate FROM ({PACKETS}))) WHERE before IS NULL OR before <> rate),
        f AS (SELECT stream_index, seq, rate, r, rate::BIGINT AS base FROM c WHERE r = 1
            UNION ALL SELECT c.stream_index, c.seq, c.rate, c.r, CASE WHEN f.base // gcd(f.base, c.rate) >= 2147483648 // c.rate THEN 28224000 ELSE f.base // gcd(f.base, c.rate) * c.rate END FROM f JOIN c ON c.stream_index = f.stream_index AND c.r = f.r + 1)
        SELECT stream_index, seq, rate AS sample_rate, base FROM f""",
)
def _(spark, d):
    rate = F.element_at(F.array(*map(F.lit, RATES)), (F.call_function("div", F.col("seq"), F.lit(300)) % 7 + 1).cast("int"))
    return frame_timing.common_rates(packets(spark, d).select("stream_index", "seq", rate.alias("sample_rate")))


# a line of an order as a stream: its flag says the mode, its number the kind, quantity and part the rates
@query(
    "output_bases",
    """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'audio' ELSE 'video' END AS kind, CAST(l_partkey AS BIGINT) * 100 + 8000 AS rate, CAST(l_quantity AS INTEGER) % 40 AS num, CAST(l_linenumber AS INTEGER) - 1 AS den,
            CAST(l_partkey AS INTEGER) % 3 * 10 AS most, CASE l_returnflag WHEN 'A' THEN 'cfr' WHEN 'N' THEN 'vfr' ELSE 'vscfr' END AS mode FROM lineitem),
        r AS (SELECT *, CASE WHEN mode <> 'vfr' AND num = 0 AND most = 0 THEN 25 ELSE num END AS n, CASE WHEN mode <> 'vfr' AND num = 0 AND most = 0 THEN 1 ELSE den END AS d FROM s),
        h AS (SELECT *, mode <> 'vfr' AND most <> 0 AND (d = 0 OR n > most * d) AS held FROM r)
        SELECT l_orderkey, l_linenumber, CASE WHEN kind = 'audio' THEN '1/' || rate WHEN held THEN '1/' || most WHEN n > 0 AND d > 0 THEN d || '/' || n ELSE '1/90000' END AS v FROM h""",
)
def _(spark, d):
    k, q, n = F.col("l_partkey"), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    mode = F.when(F.col("l_returnflag") == "A", "cfr").when(F.col("l_returnflag") == "N", "vfr").otherwise("vscfr")
    one = lambda x: F.lit(x).cast("int")
    base = frame_timing.output_base(F.when(n == 7, "audio").otherwise("video"), (k * 100 + 8_000).cast("int"), q % 40, (n - 1).cast("int"), (k % 3 * 10).cast("int"), one(1), mode, one(1), one(90_000))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(base["num"].cast("string"), F.lit("/"), base["den"].cast("string")).alias("v"))


# a base of 25 has room for all 16 bits
@query("fine_pts", f"""SELECT seq, CASE WHEN x <> round(x) THEN x + sign(x) / 131072.0::DOUBLE ELSE x END AS pts FROM (
        SELECT seq, (({nearest(f'(pts_us - {AT})', 25 * 65536, 1000000)} - {nearest('1500000', 25 * 65536, 1000000)}) / 65536.0::DOUBLE) AS x FROM ({PACKETS}))""")  # fmt: skip
def _(spark, d):
    return packets(spark, d).select("seq", frame_timing.fine_pts(F.col("pts_us") - AT, 1, 1_000_000, 1, 25, 1_500_000).alias("pts"))


@query(
    "wrap_corrected",
    f"""WITH p AS (SELECT stream_index, seq, q AS pts, q - 100 AS dts, q > 45768 AS far FROM (SELECT stream_index, seq, (seq * 97 + 40000) % 65536 AS q FROM ({PACKETS}))),
        k AS (SELECT *, coalesce(bool_or(NOT far) OVER (PARTITION BY stream_index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM p)
        SELECT seq, CASE WHEN NOT done AND pts > 45768 THEN pts - 65536 ELSE pts END AS out_pts, CASE WHEN NOT done AND dts > 45768 THEN dts - 65536 ELSE dts END AS out_dts FROM k""",
)
def _(spark, d):
    p = (F.col("seq") * 97 + 40_000) % 65_536
    return frame_timing.wrap_corrected(packets(spark, d).select("stream_index", "seq", p.alias("pts"), (p - 100).alias("dts")), F.lit(13_000), 16).select("seq", "out_pts", "out_dts")


# --- folds, by recursion ---

TIMES = [AT + k * DAY for k in range(0, 20, 3)]


@query(
    "forced_keys",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT stream_index, seq, pts_us, row_number() OVER (PARTITION BY stream_index ORDER BY pts_us, seq) AS r FROM ({PACKETS})), f AS (
        SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS pts_us, 0::BIGINT AS k, false AS forced FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT p.stream_index, p.r, p.seq, p.pts_us, f.k + CASE WHEN f.k < 7 AND p.pts_us >= ({TIMES})[f.k + 1] THEN 1 ELSE 0 END, f.k < 7 AND p.pts_us >= ({TIMES})[f.k + 1] FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)
        SELECT stream_index, seq, pts_us, forced FROM f WHERE r > 0""",
)
def _(spark, d):
    return timeline.forced_keys(packets(spark, d).select("stream_index", "seq", "pts_us"), TIMES)


#: Copies of a frame and those of the frame before, by the drift of its begin and end in millionths of a tick; where the output
#: goes before, and the two drifts after that.
SYNC = {
    "cfr": ("CASE WHEN e < -1100000 THEN 0 WHEN e > 1100000 THEN (e + 500000) // 1000000 ELSE 1 END", "CASE WHEN e > 1100000 AND s > 1100000 THEN (s - 100000) // 1000000 ELSE 0 END", "nxt"),
    "vfr": ("CASE WHEN e <= -600000 THEN 0 ELSE 1 END", "0", "CASE WHEN e > 600000 THEN (i + 500000) // 1000000 ELSE nxt END"),
    "passthrough": ("1", "0", "(i + 500000) // 1000000"),
}


def sync_sql(mode: str, duration_us: int, source: str = PACKETS) -> str:
    """The drift rules of a mode at a frame a second, a frame after the other; then the last frame again, by the median of three."""
    first = "n = 0 AND 2 * s >= 1000000" if mode == "vscfr" else "false"
    copies, before, nxt = SYNC["cfr" if mode == "vscfr" else mode]
    clip = "false" if mode == "passthrough" else "t - nxt * 1000000 < 0 AND t - nxt * 1000000 + dur > 0"
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT stream_index, seq, pts_us, row_number() OVER ({W}) AS r, pts_us - first_value(pts_us) OVER ({W}) AS t, {duration_us}::BIGINT AS dur FROM ({source})),
        f AS (SELECT stream_index, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS pts_us, 0::BIGINT AS nxt, 0::BIGINT AS n, 0::BIGINT AS copies, 0::BIGINT AS before, [0, 0, 0]::BIGINT[] AS h FROM (SELECT DISTINCT stream_index FROM p)
        UNION ALL SELECT stream_index, r, seq, pts_us, nxt + c, n + c, c, least(b, c), [b, h[1], h[2]] FROM (
            SELECT stream_index, r, seq, pts_us, n, h, ({nxt})::BIGINT AS nxt, CASE WHEN ({copies}) > 3240000 THEN 0 ELSE ({copies})::BIGINT END AS c, ({before})::BIGINT AS b FROM (
                SELECT * REPLACE (CASE WHEN {first} THEN du ELSE e END AS e, CASE WHEN {first} THEN 0 ELSE s END AS s, CASE WHEN {first} THEN (i + 500000) // 1000000 ELSE nxt END AS nxt) FROM (
                    SELECT p.stream_index, p.r, p.seq, p.pts_us, f.nxt, f.n, f.h, p.dur AS du, p.t - f.nxt * 1000000 + p.dur AS e, CASE WHEN {clip} THEN 0 ELSE p.t - f.nxt * 1000000 END AS s, CASE WHEN {clip} THEN f.nxt * 1000000 ELSE p.t END AS i
                    FROM f JOIN p ON p.stream_index = f.stream_index AND p.r = f.r + 1)))),
        l AS (SELECT stream_index, list_sort(h)[2] AS again FROM (SELECT *, max(r) OVER (PARTITION BY stream_index) AS last FROM f) WHERE r = last AND r > 0)
        SELECT stream_index, seq, pts_us, {duration_us}::BIGINT AS duration_us, copies, before FROM f WHERE r > 0
        UNION ALL SELECT stream_index, NULL, NULL, NULL, again, again FROM l WHERE again > 0"""


def clocked(spark, d, duration_us):
    return packets(spark, d).select("stream_index", "seq", "pts_us", F.lit(duration_us).cast("long").alias("duration_us"))


def sync_query(name: str, mode: str, duration_us: int) -> None:
    @query(name, sync_sql(mode, duration_us))
    def _(spark, d):
        return rate.synced(clocked(spark, d, duration_us), mode, 1, cell=2_500)


for _name, _mode, _duration in (("sync_cfr", "cfr", 40_000), ("sync_vfr", "vfr", 40_000), ("sync_vscfr", "vscfr", 3_600_000_000), ("sync_passthrough", "passthrough", 40_000)):
    sync_query(_name, _mode, _duration)


# four hours a second
FAST = sync_sql("cfr", 1_000_000, f"SELECT * REPLACE (pts_us // 14400 AS pts_us) FROM ({PACKETS})")


@query(
    "sync_frames",
    f"""SELECT stream_index, first + k AS tick, CASE WHEN k < before THEN prev ELSE seq END AS seq FROM (
        SELECT *, unnest(range(copies)) AS k FROM (SELECT *, coalesce(lag(seq) OVER (PARTITION BY stream_index ORDER BY seq NULLS LAST), seq) AS prev,
            CAST(sum(copies) OVER (PARTITION BY stream_index ORDER BY seq NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - copies AS first FROM ({FAST})))""",
)
def _(spark, d):
    return rate.emitted(rate.synced(clocked(spark, d, 1_000_000).withColumn("pts_us", F.call_function("div", F.col("pts_us"), F.lit(14_400))), "cfr", 1, cell=2_500))


@query("sync_modes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'vscfr' WHEN l_quantity < 20 THEN 'cfr' WHEN l_linestatus = 'O' THEN 'vfr' ELSE 'passthrough' END AS v FROM lineitem")
def _(spark, d):
    asked = F.when(F.col("l_returnflag") == "A", "vscfr").otherwise("auto")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rate.sync_mode(asked, F.col("l_quantity") >= 20, F.col("l_linestatus") == "O").alias("v"))


@query(
    "paired_events",
    f"""WITH RECURSIVE m AS MATERIALIZED (SELECT stream_index, seq % 2 AS channel, seq, event_type = 'signup' AS start, pts_us, row_number() OVER (PARTITION BY stream_index, seq % 2 ORDER BY seq) AS r FROM ({PACKETS}) WHERE event_type IN ('signup', 'purchase')),
        f AS (SELECT stream_index, channel, 0::BIGINT AS r, []::BIGINT[] AS pending, NULL::BIGINT AS begun, NULL::BIGINT AS ended FROM (SELECT DISTINCT stream_index, channel FROM m)
            UNION ALL SELECT m.stream_index, m.channel, m.r, CASE WHEN m.start THEN list_append(f.pending, m.pts_us) ELSE f.pending[2:] END, CASE WHEN m.start THEN NULL ELSE f.pending[1] END, CASE WHEN m.start THEN NULL ELSE m.pts_us END
            FROM f JOIN m ON m.stream_index = f.stream_index AND m.channel = f.channel AND m.r = f.r + 1),
        pairs AS (SELECT stream_index, channel, begun AS start_us, ended AS end_us FROM f WHERE begun IS NOT NULL
            UNION ALL SELECT stream_index, channel, unnest(pending), {AT + 400 * DAY} FROM (SELECT *, max(r) OVER (PARTITION BY stream_index, channel) AS last FROM f) WHERE r = last)
        SELECT stream_index, channel, start_us, end_us FROM pairs WHERE end_us - start_us >= 0""",
)
def _(spark, d):
    p = packets(spark, d).where("event_type in ('signup', 'purchase')")
    marks = p.select("stream_index", (F.col("seq") % 2).alias("channel"), "seq", F.when(F.col("event_type") == "signup", "start").otherwise("end").alias("kind"), "pts_us")
    return analysis.paired(marks, F.lit(AT + 400 * DAY), 0)


# --- jumps and the clock of sound ---

# an asset a user, a stream a type; a day is 17 seconds, and a type other than the first two shows no jumps
JUMPY = f"""SELECT stream_index AS asset_id, seq, type AS s, type < 2 AS timed, CASE WHEN seq % 7 <> 3 THEN (pts_us - {AT}) // 5000 END AS dts, (pts_us - {AT}) // 5000 + 80000 AS pts,
        CASE type WHEN 1 THEN 1000000 * 1024 // 48000 WHEN 0 THEN CASE WHEN seq % 2 = 0 THEN size * 1000 ELSE 40000 END ELSE 0 END AS du,
        row_number() OVER ({W}) AS r FROM (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS type FROM ({PACKETS}))"""


def jumpy(spark, d, slow=5_000):
    """Pictures (a duration, or none and 25 a second), sound of 1024 samples, and subtitles; time goes ``slow`` times slower."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 ELSE 2 END")
    t = F.call_function("div", F.col("pts_us") - AT, F.lit(slow))
    rows = packets(spark, d).withColumn("asset_id", F.col("stream_index")).withColumn("stream_index", kind.cast("long"))
    of = lambda n, v: F.when(F.col("stream_index") == n, F.lit(v).cast("int"))
    return rows.select(
        "asset_id", "seq", "stream_index", F.expr("CASE stream_index WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'subtitle' END").alias("kind"),
        F.when(F.col("seq") % 7 != 3, t).alias("dts_us"), (t + 80_000).alias("pts_us"), F.when(F.col("seq") % 2 == 0, F.col("size") * 1_000).alias("duration_us"),
        of(1, 1_024).alias("frame_size"), of(1, 48_000).alias("sample_rate"), of(0, 25).alias("rate_num"), of(0, 1).alias("rate_den"), F.lit(80_000).cast("long").alias("delay_us"),
    )


def intake_sql(jump: str, stray: str = "false") -> str:
    """A packet after the other, in output time. ``seen`` and ``due`` hold a number a stream; ``jump`` says of the stamp x of a packet
    that shows jumps whether it is one, by n (seen), d (due) and l (the asset's last); ``stray`` of a stamp {{}} whether it goes."""
    gone = lambda c: f"CASE WHEN timed AND x IS NOT NULL AND d IS NOT NULL AND {stray.format(c)} THEN NULL ELSE {c} - j END"
    lists = lambda new, old: ", ".join(f"CASE WHEN s = {i} THEN {new} ELSE {old}[{i + 1}] END" for i in range(3))
    return f"""WITH RECURSIVE p AS MATERIALIZED ({JUMPY}), f AS (
        SELECT asset_id, 0::BIGINT AS r, 0::BIGINT AS seq, 0::BIGINT AS off, 0::BIGINT AS l, [NULL, NULL, NULL]::BIGINT[] AS seen, [NULL, NULL, NULL]::BIGINT[] AS due,
            NULL::BIGINT AS out_dts, NULL::BIGINT AS out_pts, NULL::BIGINT AS expected FROM (SELECT DISTINCT asset_id FROM p)
        UNION ALL SELECT asset_id, r, seq, (off - j)::BIGINT, CASE WHEN timed AND o IS NOT NULL THEN o ELSE l END, [{lists("m", "seen")}], [{lists("m + du", "due")}], o, q, m
        FROM (SELECT *, coalesce(o, d, coalesce(q, 0) - 80000) AS m FROM (SELECT *, ({gone('x')})::BIGINT AS o, ({gone('y')})::BIGINT AS q FROM (
            SELECT *, CASE WHEN timed AND x IS NOT NULL AND ({jump}) THEN x - coalesce(d, l) ELSE 0 END AS j FROM (
                SELECT p.asset_id, p.r, p.seq, p.s, p.timed, p.du, f.off, f.l, f.seen, f.due, p.dts + f.off AS x, p.pts + f.off AS y, f.seen[p.s + 1] AS n, f.due[p.s + 1] AS d
                FROM f JOIN p ON p.asset_id = f.asset_id AND p.r = f.r + 1)))))
        SELECT asset_id, seq, out_dts, out_pts, expected AS expected_us, off AS offset_us FROM f WHERE r > 0"""


FAR = "abs(x - coalesce(d, l)) > 10000000 OR coalesce(x + 100000 < n, false)"
TAKEN = ("asset_id", "seq", "out_dts", "out_pts", "expected_us", "offset_us")


@query("rejoined", intake_sql(FAR))
def _(spark, d):
    return intake.taken_in(jumpy(spark, d), cell=2_500).select(*TAKEN)


# a turn of ten minutes: a stamp that lies near where it would be a turn later has wrapped
@query("rejoined_copied", intake_sql(f"d IS NOT NULL AND abs(x + 600000000 - d) < abs(x - d) // 10 AND ({FAR})"))
def _(spark, d):
    return intake.taken_in(jumpy(spark, d), intake.Rules(copyts=True, turn_us=600_000_000), cell=2_500).select(*TAKEN)


@query("without_strays", intake_sql("false", "abs({} - d) > 108000000000").replace(f"(pts_us - {AT}) // 5000", f"(pts_us - {AT})"))
def _(spark, d):
    return intake.taken_in(jumpy(spark, d, 1), intake.Rules(jumps=False), cell=2_500).select(*TAKEN)


# stamps of a container in milliseconds, a fifth of them missing; every 50 frames the sound goes on at the next full minute
@query("sound_stamps", f"SELECT stream_index, seq, r // 50 * 60 * 44100 + r % 50 * 1024 AS out_pts FROM (SELECT stream_index, seq, row_number() OVER ({W}) - 1 AS r FROM ({PACKETS}))")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("stream_index").orderBy("seq")) - 1
    rows = packets(spark, d).select("stream_index", "seq", r.cast("long").alias("r")).withColumn("k", F.col("r") % 50)
    ms = F.call_function("div", F.col("r"), F.lit(50)) * 60_000 + F.round(F.col("k") * 1_024_000 / 44_100).cast("long")
    given = F.when((F.col("k") == 0) | (F.col("seq") % 5 != 2), ms)
    frames = rows.select("stream_index", "seq", given.alias("pts"), F.lit(1).alias("num"), F.lit(1_000).alias("den"), F.lit(44_100).alias("sample_rate"), F.lit(1_024).alias("samples"))
    return frame_timing.sound_stamps(frames).select("stream_index", "seq", "out_pts")


# --- limits ---


@query(
    "limited_shortest",
    f"""WITH p AS (SELECT *, pts_us + 40000 AS end_us, row_number() OVER ({W}) AS n FROM ({TYPED})), c AS (SELECT max(end_us) AS cut FROM p WHERE stream_index = 1 AND n <= 30)
        SELECT stream_index, seq FROM p, c WHERE end_us <= cut AND (stream_index <> 1 OR n <= 30)""",
)
def _(spark, d):
    return timeline.limited(typed_packets(spark, d).withColumn("end_us", F.col("pts_us") + 40_000), 1, 30).select("stream_index", "seq")


@query("trailing_dts", f"SELECT 0 AS asset_id, min(dts) AS dts FROM (SELECT stream_index, arg_max(pts_us - seq % 3 * 1000, seq) AS dts FROM ({TYPED}) WHERE stream_index NOT IN (0, 3) GROUP BY 1)")
def _(spark, d):
    return timeline.trailing_dts(typed_packets(spark, d).withColumn("dts", F.col("pts_us") - F.col("seq") % 3 * 1000), [0, 3])


# --- chains of filters ---


@dataclass
class Louder(chain.Filter):
    """Tells the filters behind it the greatest size so far; lets only what is over half of it pass."""

    most: int = 0

    def frame(self, shared, frame):
        self.most = shared["most"] = max(self.most, frame["size"])
        return frame if 2 * frame["size"] > self.most else None


@dataclass
class Delayed(chain.Filter):
    """Puts out frames three frames late, with what is the greatest size by then; the last three at the end."""

    held: list = field(default_factory=list)

    def frame(self, shared, frame):
        self.held.append(frame)
        return None

    def more(self, shared, ended):
        if self.held and (ended or len(self.held) > 3):
            return {**self.held.pop(0), "most": shared["most"]}


@query(
    "filter_chain",
    f"""WITH m AS (SELECT *, max(size) OVER (PARTITION BY stream_index ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM ({PACKETS})),
        p AS (SELECT *, row_number() OVER ({W}) AS r, count(*) OVER (PARTITION BY stream_index) AS n FROM m WHERE 2 * size > top),
        e AS (SELECT stream_index, max(top) AS top FROM m GROUP BY 1)
        SELECT p.stream_index, q.seq, p.pts_us, coalesce(q.top, e.top) AS most FROM p JOIN e USING (stream_index) LEFT JOIN p q ON q.stream_index = p.stream_index AND q.r = p.r + 3""",
)
def _(spark, d):
    out = chain.filtered(packets(spark, d), lambda: [Louder(), Delayed()], ["pts_us", "size"], "pts_us bigint, most bigint", cell=2_500)
    return out.select("stream_index", "seq", "pts_us", "most")
