"""Folds and closed forms: unit vectors, and equality with plain loops on seeded random input."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinoframe.functions import rational
from kinoframe.operators import analysis, frame_timing, gop, samples, sampling, timeline


def packets(spark, rows, schema="stream_index long, seq long, pts_us long"):
    return spark.createDataFrame(rows, schema)


def test_rescale_rounds_halves_away_from_zero(spark):
    rows = spark.createDataFrame([(5, 1), (3, 2), (-3, 3), (1 << 40, 4)], "ts long, k int")
    got = [r.v for r in rows.select(rational.rescale_q(F.col("ts"), 1, 25, 1, 44_100).alias("v"), "k").orderBy("k").collect()]
    assert got == [8820, 5292, -5292, (1 << 40) * 1764]
    halves = [r.v for r in rows.select(rational.rescale_q(F.col("ts"), 1, 2, 1, 1).alias("v"), "k").orderBy("k").collect()]
    assert halves[:3] == [3, 2, -2]


def test_every_sec_anchors_at_the_first_frame(spark):
    rows = packets(spark, [(1, i, t) for i, t in enumerate([0, 400_000, 1_000_000, 1_900_000, 12_000_000, 12_500_000])])
    assert [r.seq for r in sampling.every_sec(rows, 1).orderBy("seq").collect()] == [0, 2, 4]


def test_every_nth(spark):
    rows = packets(spark, [(1, i, i) for i in range(7)])
    assert [r.seq for r in sampling.every_nth(rows, 3).orderBy("seq").collect()] == [0, 3, 6]


def test_uniform_n_takes_the_frame_shown_then(spark):
    rows = packets(spark, [(1, i, 100_000 * i) for i in range(17)])
    got = [(r.target, r.seq) for r in sampling.uniform_n(rows, 16).orderBy("target").collect()]
    assert got == [(i, i) for i in range(16)]


def strict_loop(stamps):
    last, out = None, []
    for d in stamps:
        last = d if last is None or d is None else max(d, last + 1)
        out.append(last)
    return out


def test_strict_dts_equals_the_loop(spark):
    pick = random.Random(3)
    rows = [(s, i, pick.randrange(40), pick.randrange(40) if pick.random() < 0.9 else None) for s in range(20) for i in range(25)]
    df = packets(spark, rows, "stream_index long, seq long, pts long, dts long")
    for cell in (1 << 20, 4):
        got = {(r.stream_index, r.seq): (r.out_dts, r.out_pts) for r in timeline.monotone_dts(df, cell=cell).collect()}
        for s in range(20):
            mine = [r for r in rows if r[0] == s]
            for r, want in zip(mine, strict_loop([r[3] for r in mine])):
                assert got[s, r[1]] == (want, r[2] if want is None else max(r[2], want))


def test_groups_are_numbered_alike_in_cells_of_any_size(spark):
    pick = random.Random(5)
    rows = [(s, i, pick.random() < 0.2) for s in range(6) for i in range(40)]
    df = packets(spark, rows, "stream_index long, seq long, is_key boolean")
    want, gop_id = {}, 0
    for s, i, key in rows:
        gop_id = 0 if i == 0 else gop_id + key
        want[s, i] = gop_id
    for cell in (1 << 20, 7, 1):
        assert {(r.stream_index, r.seq): r.gop_id for r in gop.with_gop(df, cell).collect()} == want
    first = {s: min(i for t, i, key in rows if t == s and key) for s in range(6)}
    assert {(r.stream_index, r.seq) for r in gop.gated(df).collect()} == {(s, i) for s, i, _ in rows if i >= first[s]}


def test_resampling_goes_on_from_chunk_to_chunk(spark):
    pick = np.random.default_rng(2)
    whole = pick.normal(size=61)
    cuts = [0, 1, 9, 9, 30, 61]
    rows = [(4, i, 100, 1, whole[a:b].tolist()) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    df = spark.createDataFrame(rows, "asset_id long, index long, sample_rate int, channels int, data array<double>")
    for rate in (7, 50, 100, 130, 441):
        got = [x for r in samples.resampled(df, rate).orderBy("first").collect() for x in r.data]
        n = len(whole) * rate // 100
        assert got == pytest.approx(np.interp(np.arange(n) * 100 / rate, np.arange(len(whole)), whole).tolist())


def test_sound_follows_its_clock_and_gaps_set_it_anew(spark):
    rows = [(0, 0, 0), (0, 1, 23), (0, 2, 46), (0, 3, None), (0, 4, 1_000), (0, 5, 1_023)]
    df = packets(spark, rows, "stream_index long, seq long, pts long")
    frames = df.select("*", F.lit(1).alias("num"), F.lit(1_000).alias("den"), F.lit(44_100).alias("sample_rate"), F.lit(1_024).alias("samples"))
    assert [r.out_pts for r in frame_timing.sound_stamps(frames).orderBy("seq").collect()] == [0, 1024, 2048, 3072, 44_100, 45_124]


def test_strict_sink_sees_duplicate_stamps(spark):
    df = packets(spark, [(0, 0, 3, 0), (0, 1, 3, 3), (0, 2, 4, 2)], "stream_index long, seq long, pts long, dts long")
    got = {r.seq: (r.pts_again, r.dts_back) for r in timeline.violations(df).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_forced_keys_take_one_time_a_frame(spark):
    df = packets(spark, [(0, i, i * 1_000_000) for i in range(5)])
    got = [r.seq for r in timeline.forced_keys(df, [500_000, 600_000, 3_000_000]).where("forced").orderBy("seq").collect()]
    assert got == [1, 2, 3]


def pair_loop(events, end, least):
    pending, out = {}, []
    for channel, kind, t in events:
        if kind == "start":
            pending.setdefault(channel, []).append(t)
        elif pending.get(channel):
            out.append((channel, pending[channel].pop(0), t))
    out += [(c, t, end) for c, ts in pending.items() for t in ts]
    return sorted(x for x in out if x[2] - x[1] >= least)


def test_pairs_equal_the_loop(spark):
    pick = random.Random(11)
    for _ in range(3):
        events = [(pick.randrange(3), pick.choice(["start", "end"]), 10 * i) for i in range(60)]
        df = spark.createDataFrame([(0, c, i, k, t) for i, (c, k, t) in enumerate(events)], "stream_index long, channel int, seq long, kind string, pts_us long")
        got = sorted((r.channel, r.start_us, r.end_us) for r in analysis.paired(df, F.lit(600), 20).collect())
        assert got == pair_loop(events, 600, 20)


@pytest.mark.parametrize("limiting, want", [([0, 1], {0: 2, 1: 3, 2: 2}), ([1], {0: 2, 1: 3, 2: 3})])
def test_shortest(spark, limiting, want):
    ends = {0: [10, 30], 1: [10, 20, 30], 2: [15, 29, 30, 60] if limiting == [1] else [15, 29, 31]}
    rows = [(0, s, i, e) for s, es in ends.items() for i, e in enumerate(es)]
    df = spark.createDataFrame(rows, "asset_id long, stream_index long, seq long, end_us long")
    got = {r.stream_index: r["count"] for r in timeline.shortest(df, limiting).groupBy("stream_index").count().collect()}
    assert got == want


def queue(arrivals, limiting):
    """Arrivals (stream, seq, end) of an asset through queues, one after the other: (stream, seq) as they leave."""
    used = {s for s, _, e in arrivals if s in limiting and e is not None}
    held = any(s in limiting for s, _, _ in arrivals)
    waiting, come, out = {}, {}, []
    for s, i, e in arrivals:
        waiting.setdefault(s, []).append((i, e))
        if e is not None:
            come[s] = max(e, come.get(s, e))
        head = min(come[x] for x in used) if used and used <= set(come) else None
        for x in sorted(waiting):
            while waiting[x] and (not held or waiting[x][0][1] is None or head is not None and waiting[x][0][1] <= head):
                out.append((x, waiting[x].pop(0)[0]))
    return out


def test_queues_let_go_what_is_not_past_the_shortest(spark):
    pick = random.Random(4)
    fixed = [(0, 10), (0, None), (1, 20), (0, 40), (0, None), (1, 15), (1, 30), (0, 12), (2, 30), (2, None)]
    assets = {7: [(s, i, e) for i, (s, e) in enumerate(fixed)], 8: [(0, 1, 5), (0, 2, None)], 9: [(1, 0, None), (0, 1, 3), (2, 2, None)]}
    assert queue(assets[7], {1}) == [(0, 0), (0, 1), (1, 2), (1, 5), (1, 6), (2, 8), (2, 9)]
    for a in range(10, 30):
        assets[a] = [(pick.randrange(4), i, pick.randrange(i, i + 9) if pick.random() < 0.8 else None) for i in range(30)]
    rows = [(a, s, i, e if e is None or s % 2 else e * 2, 1, 25 if s % 2 else 50) for a, own in assets.items() for s, i, e in own]
    df = spark.createDataFrame(rows, "asset_id long, stream_index long, seq long, end long, num int, den int")
    for limiting in ([1], [1, 3]):
        want = {a: queue(own, set(limiting)) for a, own in assets.items()}
        for cell in (1 << 18, 7):
            got = {}
            for r in timeline.released(df, limiting, cell).orderBy("asset_id", "position").collect():
                got.setdefault(r.asset_id, []).append((r.stream_index, r.seq))
            assert got == {a: o for a, o in want.items() if o}
        micros = df.withColumn("end_us", F.col("end") * 1_000_000 / F.col("den")).withColumn("end_us", F.col("end_us").cast("long"))
        assert {(r.asset_id, r.seq) for r in timeline.shortest(micros, limiting).collect()} == {(a, i) for a, o in want.items() for _, i in o}


def test_mux_order_keeps_packets_without_dts_and_spreads_outliers(spark):
    rows = [(1, s, i, None if i % 4 == 1 else (i if i != 6 else 1 << 50)) for i in range(12) for s in (0, 1)]
    df = spark.createDataFrame(rows, "asset_id long, stream_index long, seq long, dts long")
    place, want = {}, []
    for a, s, i, d in rows:
        place[s] = d if d is not None else place.get(s)
        want.append((place[s] is not None, place[s] or 0, s, i))
    got = timeline.interleaved(df, 16, 5).orderBy("position").collect()
    assert [(r.stream_index, r.seq) for r in got] == [(s, i) for _, _, s, i in sorted(want)] and [r.position for r in got] == list(range(1, 25))
    spans = df.withColumn("cell", timeline.spread(df, "dts", 16)).groupBy("cell").count().collect()
    assert max(r["count"] for r in spans) <= 6


def test_stamps_and_durations_build_on_each_other(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 1, None, 0), (0, 2, 20, 0)], "stream_index long, seq long, pts long, duration long")
    for cell in (1 << 18, 1):
        assert [(r.out_pts, r.estimate) for r in frame_timing.timed_frames(df, cell=cell).orderBy("seq").collect()] == [(0, 5), (5, 5), (20, 15)]
    assert [(r.out_pts, r.estimate) for r in frame_timing.timed_frames(df, forced=True).orderBy("seq").collect()] == [(0, 1), (1, 1), (2, 1)]
