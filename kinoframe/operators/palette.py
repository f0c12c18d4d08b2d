"""A clip's palette: a weighted median cut over its colours, and each pixel's nearest entry.

Colours are counted in 32 768 cells of eight values an axis, before anything is shuffled, so a clip's histogram is bounded
however long it is. The cut works on cells at their centres; an entry is the mean of all pixels of its cells. For the nearest
entry each occupied cell keeps only the entries that can be nearest to some colour in it, and pixels meet them by cell: no
task has a clip's pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("r", "g", "b")
SIDE = 8


def cells(pixels: DataFrame) -> DataFrame:
    """(clip, cr, cg, cb, n, r, g, b): the pixels of each cell, and their sums."""
    place = [F.shiftright(c, 3).alias(f"c{c}") for c in AXES]
    return pixels.groupBy("clip", *place).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in AXES])


def spread_of(at: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The greatest sum of squared deviations along an axis, and that axis; whole numbers up to the last division."""
    total = int(n.sum())
    each = [(int((n * x * x).sum()) * total - int((n * x).sum()) ** 2) / total for x in at.T]
    axis = max(range(3), key=lambda k: each[k])
    return each[axis], axis


def median_cut(at: np.ndarray, n: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells (centres and weights) in at most ``most`` boxes: the one with the greatest spread is cut at its weighted median, over and
    over. Of equal boxes the first is cut, of equal axes the first."""
    boxes = [np.arange(len(n))] if len(n) else []
    scores = [spread_of(at, n)] if boxes else []
    while len(boxes) < most and (best := max(range(len(boxes)), key=lambda i: scores[i][0])) is not None and scores[best][0] > 0:
        box, axis = np.sort(boxes[best]), scores[best][1]
        box = box[np.argsort(at[box, axis], kind="stable")]
        weight = np.cumsum(n[box])
        cut = min(int(np.searchsorted(2 * weight, weight[-1])) + 1, len(box) - 1)
        boxes[best : best + 1] = [box[:cut], box[cut:]]
        scores[best : best + 1] = [spread_of(at[b], n[b]) for b in (box[:cut], box[cut:])]
    return boxes


def palettes(counted: DataFrame, most: int = 256) -> DataFrame:
    """(clip, entry, r, g, b): the palette of each clip of ``cells``; a clip is at most 32 768 rows."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cr", "cg", "cb"])
        n = rows["n"].to_numpy()
        boxes = median_cut(rows[["cr", "cg", "cb"]].to_numpy(np.int64) * SIDE + SIDE // 2, n, most)
        sums = rows[list(AXES)].to_numpy(np.int64)
        mean = [[(2 * int(s) + int(n[b].sum())) // (2 * int(n[b].sum())) for s in sums[b].sum(0)] for b in boxes]
        return pd.DataFrame({"clip": rows["clip"].iloc[0], "entry": range(len(boxes)), **{c: [m[k] for m in mean] for k, c in enumerate(AXES)}})

    return counted.groupBy("clip").applyInPandas(cut, "clip long, entry int, r int, g int, b int")


def square(x: Column) -> Column:
    return x * x


def candidates(counted: DataFrame, entries: DataFrame) -> DataFrame:
    """Of each occupied cell the entries that can be nearest to a colour in it: those that come nearer to it than the least of all
    can be away from its farthest corner."""
    own = entries.groupBy("clip").agg(F.collect_list(F.struct("entry", *AXES)).alias("all"))
    low = {c: F.col(f"c{c}") * SIDE for c in AXES}
    gap = lambda v, c: F.greatest(low[c] - v, v - low[c] - (SIDE - 1), F.lit(0))
    reach = lambda v, c: F.greatest(F.abs(v - low[c]), F.abs(v - low[c] - (SIDE - 1)))
    rows = counted.select("clip", *[f"c{c}" for c in AXES]).join(own, "clip")
    rows = rows.withColumn("_reach", F.array_min(F.transform("all", lambda e: sum((square(reach(e[c], c)) for c in AXES), F.lit(0)))))
    return rows.select("clip", *[f"c{c}" for c in AXES], F.filter("all", lambda e: sum((square(gap(e[c], c)) for c in AXES), F.lit(0)) <= F.col("_reach")).alias("near"))


def mapped(pixels: DataFrame, counted: DataFrame, entries: DataFrame) -> DataFrame:
    """Pixels with ``entry``, the nearest of their clip's palette, the first of equals."""
    near = candidates(counted, entries)
    rows = pixels.withColumns({f"c{c}": F.shiftright(c, 3) for c in AXES}).join(near, ["clip", *[f"c{c}" for c in AXES]])
    away = F.transform("near", lambda e: F.struct(sum((square(e[c] - F.col(c)) for c in AXES), F.lit(0)).alias("d"), e["entry"].alias("entry")))
    return rows.withColumn("entry", F.array_min(away)["entry"]).drop("near", *[f"c{c}" for c in AXES])
