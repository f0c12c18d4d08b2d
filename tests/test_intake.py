"""Input stamps: the rules one by one, and cells of any size against the packets one after another."""

import random

import pytest

from kinoframe.operators import intake

SECOND = 1_000_000
SCHEMA = "asset_id long, seq long, stream_index long, kind string, dts_us long, pts_us long, duration_us long, frame_size int, sample_rate int, rate_num int, rate_den int, delay_us long"


def row(seq, stream, dts, *, asset=1, kind="video", pts=None, duration=SECOND, frame_size=None, sample_rate=None, rate=(None, None), delay=None):
    return (asset, seq, stream, kind, dts, pts, duration, frame_size, sample_rate, *rate, delay)


def told(rows, rules=intake.Rules()):
    states, out = {}, []
    for r in rows:
        out.append(rules.packet(states.setdefault(r[0], intake.Intake()), *r[2:]))
    return out


def test_a_jump_is_taken_out_of_all_streams():
    rows = [row(i, i % 2, (i + (3_600 if i >= 6 else 0)) * SECOND, duration=2 * SECOND) for i in range(10)]
    out = told(rows)
    assert [x[0] for x in out] == [i * SECOND for i in range(10)] and out[-1][3] == -3_600 * SECOND


def test_copied_stamps_lose_wraps_alone():
    turn = 1 << 33
    rows = [row(i, 0, (i * SECOND if i < 3 else i * SECOND - turn), duration=SECOND) for i in range(6)]
    assert [x[0] for x in told(rows, intake.Rules(copyts=True, turn_us=turn))] == [i * SECOND for i in range(6)]
    far = [row(0, 0, 0), row(1, 0, 500 * SECOND), row(2, 1, 900 * SECOND)]
    assert [x[0] for x in told(far, intake.Rules(copyts=True, turn_us=turn))] == [0, 500 * SECOND, 900 * SECOND]
    assert [x[0] for x in told(far)] == [0, SECOND, SECOND]


def test_stamps_before_the_start_come_from_before_the_wrap():
    rules = intake.Rules(start_us=10, turn_us=1_000, jumps=False)
    assert [x[0] for x in told([row(0, 0, 990), row(1, 0, 5), row(2, 0, 995)], rules)] == [-10, 5, 995]


def test_offset_scale_and_loop_come_in_this_order():
    rules = intake.Rules(shift_us=-7, scale=0.5, loop_us=100, jumps=False)
    assert told([row(0, 0, 10, pts=4)], rules)[0][:2] == (101, 99)


def test_expected_stamps():
    sound = [row(i, 0, None if i else 0, kind="audio", frame_size=1024, sample_rate=44_100) for i in range(3)]
    assert [x[2] for x in told(sound)] == [0, 23_219, 46_438]
    pictures = [row(i, 0, None if i else 0, duration=None, rate=(30_000, 1_001)) for i in range(3)]
    assert [x[2] for x in told(pictures)] == [0, 33_367, 66_734]
    grid = [row(i, 0, None if i else 0) for i in range(3)]
    assert [x[2] for x in told(grid, intake.Rules(rate=(30_000, 1_001)))] == [0, 33_367, 66_733]
    assert told([row(0, 0, None, pts=SECOND, delay=80_000)])[0][2] == SECOND - 80_000


def test_strays_are_dropped():
    rules = intake.Rules(jumps=False)
    far = intake.STRAY + 2 * SECOND
    assert [x[:2] for x in told([row(0, 0, 0, pts=0), row(1, 0, far, pts=5)], rules)] == [(0, 0), (None, 5)]


@pytest.mark.parametrize("rules", [intake.Rules(), intake.Rules(copyts=True, turn_us=1 << 33), intake.Rules(jumps=False), intake.Rules(rate=(25, 1), scale=0.9), intake.Rules(start_us=0, turn_us=1 << 33, loop_us=77)])
def test_cells_of_any_size(spark, rules):
    pick = random.Random(5)
    rows = []
    for asset in (None, 1, 2):
        shift = 0
        for i in range(70):
            shift += pick.choice([0] * 12 + [50 * SECOND, -80 * SECOND, 1 << 33])
            s = pick.randrange(3)
            t = i * SECOND // 3 + shift
            dts = None if pick.random() < 0.15 else t
            rows.append(row(i, s, dts, asset=asset, kind=("video", "audio", "subtitle")[s], pts=None if pick.random() < 0.2 else t + 80_000, frame_size=1024 if s == 1 else None, sample_rate=48_000 if s == 1 else None, delay=40_000))
    df = spark.createDataFrame(rows, SCHEMA)
    order = lambda r: tuple((v is None, v or 0) for v in r)
    want = sorted(((r[0], r[1], *x) for r, x in zip(rows, told(rows, rules))), key=order)
    for cell in (1 << 18, 16, 5):
        got = intake.taken_in(df, rules, cell).select("asset_id", "seq", "out_dts", "out_pts", "expected_us", "offset_us").collect()
        assert sorted(map(tuple, got), key=order) == want
