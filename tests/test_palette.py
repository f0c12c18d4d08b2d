"""Palettes against plain lists: the cut, the means and every pixel's nearest entry."""

import random

import pytest

from kinoframe.operators import palette


def plain(pixels, most):
    """The cut over lists of pixels, cell by cell, and the nearest entry by comparing with all."""
    def centre(p):
        return tuple(c // 8 * 8 + 4 for c in p)

    def spread(box):
        best = (-1.0, 0)
        for k in range(3):
            xs = [centre(p)[k] for p in box]
            s = (sum(x * x for x in xs) * len(xs) - sum(xs) ** 2) / len(xs)
            best = max(best, (s, -k))
        return best[0], -best[1]

    boxes = [sorted(pixels, key=centre)]
    while len(boxes) < most:
        scores = [spread(b) for b in boxes]
        i = max(range(len(boxes)), key=lambda j: (scores[j][0], -j))
        if scores[i][0] <= 0:
            break
        groups = {}
        for p in sorted(boxes[i], key=centre):
            groups.setdefault(centre(p), []).append(p)
        order = sorted(groups, key=lambda c: c[scores[i][1]])
        taken, cut = 0, 0
        while 2 * taken < len(boxes[i]):
            taken += len(groups[order[cut]])
            cut += 1
        cut = min(cut, len(order) - 1)
        boxes[i : i + 1] = [[p for c in part for p in groups[c]] for part in (order[:cut], order[cut:])]
    entries = [tuple((2 * sum(p[k] for p in b) + len(b)) // (2 * len(b)) for k in range(3)) for b in boxes]
    nearest = [min(range(len(entries)), key=lambda e: (sum((x - y) ** 2 for x, y in zip(p, entries[e])), e)) for p in pixels]
    return entries, nearest


@pytest.mark.parametrize("most", [1, 2, 7, 64])
def test_palettes_equal_plain_cuts(spark, most):
    pick = random.Random(most)
    clips = {
        1: [tuple(pick.randrange(256) for _ in range(3)) for _ in range(150)],
        2: [pick.choice([(0, 0, 0), (255, 255, 255), (9, 9, 9), (10, 200, 30)]) for _ in range(60)],
        3: [(7, 7, 7)] * 5,
        4: [tuple(min(255, max(0, int(pick.gauss(120, 30)))) for _ in range(3)) for _ in range(200)],
    }
    rows = [(c, i, *p) for c, ps in clips.items() for i, p in enumerate(ps)]
    pixels = spark.createDataFrame(rows, "clip long, i int, r int, g int, b int").repartition(3)
    counted = palette.cells(pixels).cache()
    entries = palette.palettes(counted, most).cache()
    got = {}
    for r in entries.orderBy("entry").collect():
        got.setdefault(r.clip, []).append((r.r, r.g, r.b))
    found = {(r.clip, r.i): r.entry for r in palette.mapped(pixels, counted, entries).collect()}
    for c, ps in clips.items():
        want, nearest = plain(ps, most)
        assert got[c] == want and [found[c, i] for i in range(len(ps))] == nearest
    near = palette.candidates(counted, entries).selectExpr("avg(size(near))").first()[0]
    assert most < 64 or near < 20
    assert palette.palettes(counted.where("false")).count() == 0
