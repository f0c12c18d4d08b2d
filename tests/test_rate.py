"""Rate conversion: composed cells against the frames one by one, thresholds, and the end of a stream."""

import random

import pytest

from kinoframe.operators import rate

M = 1_000_000


def frames(pick, n, jump):
    t, out = 0, []
    for _ in range(n):
        length = pick.choice([M, M, M // 2, 2 * M, 40_000, 0])
        out.append((t, length))
        t += pick.choice([M, M, M // 2, 1_500_000, 333_333, 0, -700_000, jump])
    return out


def test_composed_ticks_equal_the_frames_one_by_one():
    pick = random.Random(3)
    for n in range(400):
        rows = frames(pick, pick.randrange(9), pick.choice([5 * M, -9 * M, rate.MOST * M + 3 * M]))
        ticks = rate.Ticks()
        for r in rows:
            ticks.then(*r)
        known = 0
        for x in [*range(-12, 20), -rate.MOST - 3]:
            state = rate.Output(x, False, (1, 2, 3))
            if (got := ticks.after(rate.Output(x, False, (1, 2, 3)))) is not None:
                for r in rows:
                    state.take(*r, rate.MODES["cfr"])
                assert got == state, (rows, x)
                known += 1
        assert known or n


def test_constant_rates_halve_and_double():
    fast = rate.fold([(i * M // 2, M // 2) for i in range(12)], "cfr")
    assert sum(c for c, _ in fast) == 8  # six ticks, and the two that the output may run ahead by
    slow = rate.fold([(i * 2 * M, 2 * M) for i in range(6)], "cfr")
    assert [c for c, _ in slow[:6]] == [2] * 6 and all(b <= c for c, b in slow)
    assert [c for c, _ in rate.fold([(t, M) for t in (0, 200_000, 5 * M, 5_100_000)], "passthrough")] == [1, 1, 1, 1]


def test_a_late_stream_ends_with_its_last_frame_again():
    gaps = [(t * M, M) for t in (0, 4, 8, 12)]
    found = rate.fold(gaps, "cfr")
    assert found == [(1, 0), (4, 2), (4, 2), (4, 2), (2, 2)]
    assert rate.fold(gaps, "vfr") == [(1, 0)] * 4 and rate.fold([], "cfr") == []


def test_a_first_frame_may_keep_its_stamp():
    assert rate.Output(waits=True).take(5 * M, M, rate.MODES["vscfr"]) == (1, 0)
    assert rate.Output().take(5 * M, M, rate.MODES["cfr"]) == (6, 4)


@pytest.mark.parametrize("mode", sorted(rate.MODES))
def test_cells_of_any_size(spark, mode):
    pick = random.Random(8)
    rows, want = [], []
    for s in (None, 1, 2):
        own = frames(pick, 40, 6 * M)
        rows += [(s, i, 7 + t, d) for i, (t, d) in enumerate(own)]
        out = rate.fold(own, mode)
        want += [(s, i, *c) for i, c in zip([*range(40), None], out)]
    df = spark.createDataFrame(rows, "stream_index long, seq long, pts_us long, duration_us long")
    order = lambda r: tuple((v is None, v or 0) for v in r)
    for cell in (1 << 18, 8, 2):
        got = rate.synced(df, mode, 1, cell)
        assert sorted((tuple(r) for r in got.select("stream_index", "seq", "copies", "before").collect()), key=order) == sorted(want, key=order)
    shown = rate.emitted(got).where("stream_index = 1").orderBy("tick").collect()
    assert [r.tick for r in shown] == list(range(sum(c for s, _, c, _ in want if s == 1)))
    assert all(r.seq is not None for r in shown)
