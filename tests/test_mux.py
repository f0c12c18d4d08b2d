"""Timestamp repair on what was written, whole and in cells, against loops."""

import random

import pytest

from kinoframe.operators import mux, scans


def written(rows, strict):
    """The rule for one stream, as a loop over (pts, dts, timed)."""
    last, out = None, []
    for pts, dts, timed in rows:
        if dts is not None:
            if pts is not None and dts > pts:
                pts = dts = min(pts, dts) if last is None else sorted([pts, dts, last + 1])[1]
            if timed and last is not None and dts < last + strict:
                if pts is not None and pts >= dts:
                    pts = max(pts, last + strict)
                dts = last + strict
        last = dts
        out.append((pts, dts))
    return out


def some(pick, n=14):
    value = lambda: pick.randrange(-3, 25) if pick.random() < 0.88 else None
    return [(value(), value()) for _ in range(n)]


@pytest.mark.parametrize("timed", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_composed_repairs_equal_the_loop_from_every_state(timed, strict):
    pick = random.Random(7)
    for _ in range(1500):
        rows = [(p, d, timed) for p, d in some(pick, pick.randrange(1, 14))]
        steps = mux.Steps()
        for p, d, t in rows:
            steps.then(p, d, t, strict)
        for x in [mux.NONE, *range(-8, 40)]:
            last = mux.Written(x)
            for p, d, t in rows:
                mux.repaired(last, p, d, t, strict)
            assert steps.after(mux.Written(x)) == last, (rows, x)
    rows = [(p, d, timed) for p, d in some(pick, 200)]
    last = mux.Written()
    assert [mux.repaired(last, p, d, t, strict) for p, d, t in rows] == written(rows, strict)


def test_first_guess_takes_what_was_written():
    last = mux.Written()
    assert [mux.repaired(last, 0, 9, True, True), mux.repaired(last, 3, 5, True, True)] == [(0, 0), (3, 3)]
    assert [mux.repaired(last, None, None, True, True), mux.repaired(last, 1, 1, True, True)] == [(None, None), (1, 1)]


def test_composed_sound_equals_the_steps_from_every_state():
    pick = random.Random(2)
    for _ in range(300):
        rate, den = pick.choice([(44_100, 1_000), (48_000, 1_000), (8_000, 90_000), (22_050, 25)])
        samples = pick.choice([0, 1024, 1152, 441])
        t, rows = 0.0, []
        for _ in range(pick.randrange(1, 12)):
            rows.append((None if pick.random() < 0.1 else round(t * den) + pick.choice([0, 0, 0, 1, -1, 40]), 1, den, rate, samples, 1, pick.choice([rate, 90_000])))
            t += samples / rate
        carry = mux.Remainder()
        for r in rows:
            carry.then(*r)
        for due in [None, *range(-60, 60), *range(900, 1200, 7)]:
            state = mux.Sound(due)
            for r in rows:
                mux.placed_sound(state, *r)
            assert carry.after(mux.Sound(due)) == state


SCHEMA = "stream_index long, seq long, kind string, copied boolean, pts long, dts long, duration long, num int, den int, sample_rate int, samples int, out_num int, out_den int, last boolean"


def test_muxed_in_cells_of_any_size(spark):
    pick = random.Random(12)
    kinds = {0: ("video", False), 1: ("audio", True), 2: ("data", False), 3: ("subtitle", True), None: ("audio", False)}
    rows = []
    for s, (kind, copied) in kinds.items():
        for i in range(60):
            p, d = some(pick, 1)[0] if not (kind == "audio" and copied) else (i * 23 + pick.randrange(2), i * 23 + pick.randrange(2))
            rows.append((s, i, kind, copied, p, d, 23, 1, 1_000, 44_100, 1_024, 1, 44_100 if kind == "audio" else 500, None))
    df = spark.createDataFrame(rows, SCHEMA)
    for strict in (True, False):
        want = {}
        for s, (kind, copied) in kinds.items():
            own = [r for r in rows if r[0] == s]
            scale = lambda x, r: None if x is None else mux.nearest(x * r[12], r[8])
            state = mux.Sound()
            dts = [mux.placed_sound(state, r[5], *r[7:13])[0] if kind == "audio" and copied else scale(r[5], r) for r in own]
            pts = dts if kind == "audio" and copied else [scale(r[4], r) for r in own]
            for r, out in zip(own, written([(p, d, kind != "data") for p, d in zip(pts, dts)], int(strict))):
                want[s, r[1]] = (*out, scale(r[6], r))
        for cell in (1 << 18, 9, 1):
            got = mux.muxed(df, strict, cell=cell).collect()
            assert {(r.stream_index, r.seq): (r.out_pts, r.out_dts, r.out_duration) for r in got} == want and len(got) == len(rows)
    assert mux.muxed(df, stamps=False).where("out_dts is not null and dts is null").count() == 0


class Total:
    def __init__(self):
        self.sum = 0

    def __eq__(self, other):
        return self.sum == other.sum


def add(state, x):
    state.sum = x if x is None or x > 90 else (state.sum or 0) + x
    return (state.sum,)


def test_speculated_cells_are_folded_until_they_agree(spark):
    pick = random.Random(1)
    rows = [(g, i, pick.randrange(100) if pick.random() < 0.9 else None) for g in (None, 1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, seq long, x long")
    want = []
    for g in (None, 1, 2):
        state = Total()
        want += [(g, i, x, *add(state, x)) for h, i, x in rows if h == g]
        want.append((g, None, None, state.sum))
    for cell in (7, 100):
        got = scans.scanned(df, ["g"], ["x"], Total, add, "total long", cell=cell, finish=lambda s: [(s.sum,)])
        order = lambda r: tuple((v is None, v or 0) for v in r)
        assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert scans.scanned(df.where("false"), ["g"], ["x"], Total, add, "total long", finish=lambda s: [(s.sum,)]).count() == 0
