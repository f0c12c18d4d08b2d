"""Fan-out, recipes and byte formats on small fixtures, nulls and empty tables included."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinoframe.functions import text
from kinoframe.operators import bitstream, fanout, masks, overrides, recipes, subtitles

MEDIA = "channel long, seq long, kind string, is_key boolean, is_header boolean, size long, digest string"


def media(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], MEDIA)


ROWS = [
    ("video", False, True, 5, "a"), ("video", True, False, 10, None), ("audio", False, False, 2, None), ("video", False, True, 5, "a"),
    ("video", False, False, 3, None), ("video", True, False, 10, None), ("video", False, True, 5, "b"), ("audio", False, False, 2, None),
    ("video", True, False, 10, None), ("video", False, False, 3, None),
]


def test_only_a_changed_header_begins_an_epoch(spark):
    got = [r.epoch for r in fanout.config_epochs(media(spark, ROWS)).orderBy("seq").collect()]
    assert got == [0] * 6 + [1] * 4


def test_a_watcher_waits_for_a_key_picture(spark):
    watchers = spark.createDataFrame([(1, 7, 2)], "channel long, watcher long, join_seq long")
    got = [r.seq for r in fanout.delivered(media(spark, ROWS), watchers).orderBy("seq").collect()]
    assert got == [3, 5, 6, 7, 8, 9]


def test_without_video_audio_flows_at_once(spark):
    watchers = spark.createDataFrame([(1, 7, 1)], "channel long, watcher long, join_seq long")
    rows = media(spark, [("audio", False, False, 2, None)] * 3)
    assert [r.seq for r in fanout.delivered(rows, watchers).orderBy("seq").collect()] == [1, 2]
    assert fanout.delivered(rows.where("false"), watchers).count() == 0


def test_replay_holds_the_current_epoch_within_budget(spark):
    watchers = spark.createDataFrame([(1, 7, 10), (1, 8, 6)], "channel long, watcher long, join_seq long")
    got = {(r.watcher, r.seq) for r in fanout.replayed(media(spark, ROWS), watchers, budget=15).collect()}
    assert {s for w, s in got if w == 7} == {7, 8, 9}
    # before the change: two groups, of which the last alone stays within the budget
    assert {s for w, s in got if w == 8} == {5}


def test_rotation_without_a_direction_is_null(spark):
    row = spark.range(1).select(recipes.rotation_degrees(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("z"), recipes.rotation_degrees(F.lit(0), F.lit(65536), F.lit(-65536), F.lit(0)).alias("q")).first()
    assert (row.z, row.q) == (None, 90)


def test_ladder_bytes_of_spans_of_years(spark):
    span = 400 * 86_400_000_000 + 1_234_567
    rows = spark.createDataFrame([(1, 0, 5, True), (1, 1, 5 + span, False)], "stream_index long, seq long, pts_us long, is_key boolean")
    (got,) = recipes.ladder(rows, [("high", 1920, 1080, 5_000_001)], 86_400_000_000).collect()
    assert got.bytes == 5_000_001 * span // 8_000_000


@pytest.mark.parametrize("sigmas", [(2.3, 1.5), (0, 1.2), (6.1, 0)])
def test_gaussian_blur_of_masks_of_many_sizes_moves_pixels_once(spark, sigmas):
    pick = random.Random(7)
    sizes = {1: (3, 4), 2: (1, 1), 3: (140, 120), None: (5, 2), 5: (3, 4)}
    rows = [(m, x - 2, y + m if m else y, pick.randrange(256) if pick.random() < 0.9 else None) for m, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    out = masks.gaussian_blurred(spark.createDataFrame(rows, "mask long, x int, y int, v int").repartition(3), *sigmas)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    wide, high = ((math.ceil(s) + 1) * 2 for s in sigmas)
    want = {}
    for m in sizes:
        own = {(x, y): v or 0 for k, x, y, v in rows if k == m}
        xs, ys = range(min(x for x, _ in own) - wide, max(x for x, _ in own) + wide + 1), range(min(y for _, y in own) - high, max(y for _, y in own) + high + 1)
        now = {(x, y): own.get((x, y), 0) for x in xs for y in ys}
        for rx, ry in zip(masks.box_radii(sigmas[0]), masks.box_radii(sigmas[1])):
            now = {(x, y): sum(now.get((x + i, y), 0) for i in range(-rx, rx + 1)) // (2 * rx + 1) for x, y in now}
            now = {(x, y): sum(now.get((x, y + i), 0) for i in range(-ry, ry + 1)) // (2 * ry + 1) for x, y in now}
        want |= {(m, x, y): v for (x, y), v in now.items()}
    got = out.collect()
    assert len(got) == len(want) and {(r["mask"], r.x, r.y): r.v for r in got} == want


def test_ladder_limits():
    with pytest.raises(ValueError):
        recipes.fanned_out(None, [])


def test_concatenation_adds_earlier_durations(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (1, 2, 7)], "asset_id long, part long, pts_us long")
    n = spark.createDataFrame([(1, 0, 100), (1, 1, 50), (1, 2, 10)], "asset_id long, part long, duration_us long")
    assert sorted(r.out_us for r in recipes.concatenated(p, n).collect()) == [0, 105, 157]


def test_noop_sink_runs_the_plan(spark):
    recipes.discarded(spark.range(10))


def test_annexb_units_by_hand():
    assert bitstream.annexb_units(b"\x00\x00\x00\x01\x67\x01\x00\x00\x01\x65\x02\x03\x00") == ([b"\x67\x01", b"\x65\x02\x03"], None)
    assert bitstream.annexb_units(b"\x01\x02\x03\x04")[1] == "no start code in front"
    assert bitstream.prefixed_units(b"\x00\x00\x00\x02\x65\x01") == ([b"\x65\x01"], None)
    assert bitstream.prefixed_units(b"\x00\x00\x00\x09\x65")[1] == "unit cut off"


@pytest.mark.parametrize("given, ms", [("0:00:01.50", 1500), ("1:02:03.4", 3_723_040), ("0:00:01", None), ("", None)])
def test_timecodes(spark, given, ms):
    assert spark.createDataFrame([(given,)], "t string").select(text.timecode_ms(F.col("t")).alias("ms")).first().ms == ms


@pytest.mark.parametrize("given, bps", [("2500k", 2_500_000), ("5M", 5_000_000), ("77", 77), ("5G", 5_000_000_000), ("2.5M", 2_500_000), ("5T", None), ("", None)])
def test_bitrates(spark, given, bps):
    assert spark.createDataFrame([(given,)], "t string").select(text.bitrate_bps(F.col("t")).alias("b")).first().b == bps


def test_script_lines_keep_commas_of_the_text(spark):
    script = "[Events]\r\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\r\nDialogue: 2,0:00:01.00,0:00:02.50,*Default,,0,0,0,,one, two, {\\i1}three"
    row = subtitles.events(spark.createDataFrame([(1, script), (2, ""), (3, None)], "script_id long, script string")).collect()
    assert [(r.layer, r.start_ms, r.duration_ms, r.text) for r in row] == [(2, 1000, 1500, "one, two, {\\i1}three")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_nearest_option_equals_comparing_all(spark):
    import random

    from kinoframe.functions import text

    pick = random.Random(3)
    word = lambda: "".join(pick.choice("ab") for _ in range(pick.randint(0, 9)))
    words, options = sorted({word() for _ in range(150)}), [word() for _ in range(40)]
    got = text.nearest(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(enumerate(options)), "place int, option string"))
    want = {}
    for w in words:
        d, place = min((edits(w, o), i) for i, o in enumerate(options))
        if d <= 2:
            want[w] = (options[place], d)
    assert {r.word: (r.option, r.distance) for r in got.collect()} == want


def test_one_pixel_spreads_into_its_room(spark):
    one = spark.createDataFrame([(1, 5, 7, 200)], "mask long, x int, y int, v int")
    got = {(r.x, r.y): r.v for r in masks.edge_blurred(one, 1).collect()}
    assert got == {(x, y): 50 // (1 << abs(x - 5) + abs(y - 7)) for x in (4, 5, 6) for y in (6, 7, 8)}
    assert masks.edge_blurred(one, 0).count() == 1 and masks.edge_blurred(one, 9).count() == 11 * 11


def test_drawings_close_splines_and_leave_odd_numbers():
    line = ["M 0 0", "L 640 0", "L 640 640", "Z"]
    assert overrides.drawing_of("m 0 0 l 10 0 10 10 5") == (line, [0, 0, 640, 640])
    closed, box = overrides.drawing_of("m 0 0 s 10 0 10 10 0 10 c")
    assert [c.split()[0] for c in closed] == ["M", *"CCCC", "Z"] and box == [0, 0, 640, 640]
    assert overrides.drawing_of("1 2 l") == ([], None) and overrides.drawing_of("") == ([], None)
