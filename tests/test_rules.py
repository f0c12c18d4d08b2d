"""Odd arguments of recipes, with stated results."""

import pytest
from pyspark.sql import functions as F

from kinoframe.functions import rules
from kinoframe.operators import frame_timing, rate

STATED = {}
item = F.element_at


def stated(name, pairs, rule):
    STATED[name] = pairs, rule


stated("scale_clauses", [([320, None], "scale=320:-2"), ([None, 240], "scale=-2:240"), ([320, 240], "scale=320:240"), ([None, None], None), ([0, 240], None), ([320, 0], None)], lambda c: rules.scale_clause(item(c, 1), item(c, 2)))
stated("sprite_grids", [([5, 4, 160, 90], True), ([0, 4, 160, 90], False), ([5, 4, 0, 90], False), ([65535, 1, 1, 1], True), ([65536, 1, 1, 1], False), ([4, 300, 100, 300], False), ([100_000, 1, 100_000, 1], False)], lambda c: rules.is_grid(*[item(c, i) for i in range(1, 5)]))
stated("gif_clauses", [
    (["12", "320", "64", "bayer", "3"], "[0:v]fps=12,scale=320:-1:flags=lanczos,split[a][b];[a]palettegen=max_colors=64[p];[b][p]paletteuse=dither=bayer:bayer_scale=3[v]"),
    (["10", None, None, "sierra2_4a", None], "[0:v]fps=10,split[a][b];[a]palettegen[p];[b][p]paletteuse=dither=sierra2_4a[v]"),
    (["15", "480", None, "none", None], "[0:v]fps=15,scale=480:-1:flags=lanczos,split[a][b];[a]palettegen[p];[b][p]paletteuse=dither=none[v]"),
], lambda c: rules.gif_clause(*[item(c, i) for i in range(1, 6)]))
stated("gif_loops", [(["infinite", "9"], "0"), (["once", "9"], "-1"), (["count", "3"], "3")], lambda c: rules.loop_value(item(c, 1), item(c, 2)))
stated("ladder_rates", [([30000, 1001, 25, 1], "30000/1001"), ([None, None, 25, 1], "25/1"), ([0, 1, 25, 1], None), ([None, None, 0, 1], None), ([None, None, 25, 0], None), ([25, -1, 25, 1], None)], lambda c: F.concat(rules.resolved_rate(*[item(c, i) for i in range(1, 5)])["num"].cast("string"), F.lit("/"), rules.resolved_rate(*[item(c, i) for i in range(1, 5)])["den"].cast("string")))
stated("black_detectors", [([2.0, 0.1, 0.98], True), ([0.0, 0.0, 1.0], True), ([-0.1, 0.1, 0.9], False), ([2.0, 1.1, 0.9], False), ([2.0, 0.1, -0.1], False)], lambda c: rules.is_black_detector(*[item(c, i) for i in range(1, 4)]))
stated("scene_detectors", [(10.0, True), (0.0, True), (100.0, True), (100.5, False), (-1.0, False)], rules.is_scene_detector)
stated("crop_detectors", [([24, 16, 0], True), ([0, 0, 2147483647], True), ([2147483648, 16, 0], False), ([24, -1, 0], False)], lambda c: rules.is_crop_detector(*[item(c, i) for i in range(1, 4)]))
stated("autorotation", [([0, 64, 48], ":64x48"), ([90, 64, 48], "transpose=clock:48x64"), ([-90, 64, 48], "transpose=cclock:48x64"), ([180, 64, 48], "hflip,vflip:64x48"), ([450, 64, 48], "transpose=clock:48x64"), ([45, 64, 48], "rotate=45*PI/180:64x48")], lambda c: F.concat(*[f(rules.turned(item(c, 1), item(c, 2), item(c, 3))) for f in (lambda t: t["step"], lambda t: F.lit(":"), lambda t: t["width"].cast("string"), lambda t: F.lit("x"), lambda t: t["height"].cast("string"))]))


def based(kind, *numbers):
    n = [x.try_cast("int") for x in numbers]
    b = frame_timing.output_base(kind, *n[:5], numbers[5], *n[6:])
    return F.concat(b["num"].cast("string"), F.lit("/"), b["den"].cast("string"))


stated("output_bases", [
    (["audio", "44100", "25", "1", "0", "1", "cfr", "1", "90000"], "1/44100"), (["video", "0", "25", "1", "0", "1", "vfr", "1", "90000"], "1/25"), (["video", "0", "30000", "1001", "0", "1", "cfr", "1", "90000"], "1001/30000"),
    (["video", "0", "0", "1", "0", "1", "cfr", "1", "90000"], "1/25"), (["video", "0", "0", "1", "0", "1", "vfr", "1", "90000"], "1/90000"), (["video", "0", "60", "1", "30", "1", "cfr", "1", "90000"], "1/30"),
    (["video", "0", "24", "1", "30", "1", "vscfr", "1", "90000"], "1/24"), (["video", "0", "60", "1", "30", "1", "vfr", "1", "90000"], "1/60"), (["video", "0", "0", "0", "30", "1", "cfr", "1", "90000"], "1/30"), (["video", "0", "60", "0", "0", "1", "passthrough", "1", "1000"], "1/1000"),
], lambda c: based(*[F.element_at(c, i) for i in range(1, 10)]))
stated("sync_modes", [(["auto", "true", "true"], "vfr"), (["auto", "true", "false"], "passthrough"), (["auto", "false", "true"], "cfr"), (["auto", "false", "false"], "cfr"), (["vscfr", "true", "true"], "vscfr")], lambda c: rate.sync_mode(F.element_at(c, 1), F.element_at(c, 2) == "true", F.element_at(c, 3) == "true"))


@pytest.mark.parametrize("name", sorted(STATED))
def test_stated_results(spark, name):
    pairs, rule = STATED[name]
    for given, want in pairs:
        x = F.array(*map(F.lit, given)) if isinstance(given, list) else F.lit(given)
        assert spark.range(1).select(rule(x).alias("v")).first().v == want, given
