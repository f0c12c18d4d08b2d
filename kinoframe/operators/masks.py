"""Coverage masks as pixels (mask, x, y, v 0 to 255): union, clips and blurs.

An edge blur is a window along rows, then one along columns; a Gaussian blur has the pixels of a mask together. Pixels of a mask are
dense: every cell of its rectangle is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinoframe.functions.pixels import alpha_fixed


def along(across: bool):
    """A window along rows, or down columns."""
    return Window.partitionBy("mask", "y").orderBy("x") if across else Window.partitionBy("mask", "x").orderBy("y")


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of each pixel the greater coverage."""
    return a.select("mask", "x", "y", "v").unionByName(b.select("mask", "x", "y", "v")).groupBy("mask", "x", "y").agg(F.max("v").alias("v"))


def clipped(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int, inverse: bool = False) -> DataFrame:
    """Coverage inside a rectangle (right and bottom edge exclusive), or with ``inverse`` outside it; the rest is zero."""
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return pixels.withColumn("v", F.when(~inside if inverse else inside, F.col("v")).otherwise(0))


def padded(pixels: DataFrame, across: int, down: int) -> DataFrame:
    """Masks with that many empty columns and rows on each side."""
    box = pixels.groupBy("mask").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    grid = box.select("mask", "y0", "y1", F.explode(F.sequence(F.col("x0") - across, F.col("x1") + across)).alias("x"))
    grid = grid.select("mask", "x", F.explode(F.sequence(F.col("y0") - down, F.col("y1") + down)).alias("y"))
    return grid.join(pixels.select("mask", "x", "y", "v"), ["mask", "x", "y"], "left").select("mask", "x", "y", F.coalesce("v", F.lit(0)).cast("int").alias("v"))


def weighted(v: str, w) -> Column:
    """Weights 1 2 1 along a window, whose ends repeat."""
    return F.coalesce(F.lag(v).over(w), F.col(v)) + F.col(v) * 2 + F.coalesce(F.lead(v).over(w), F.col(v))


def edge_room(passes: int) -> int:
    """Empty pixels that an edge blur gets on each side to spread into."""
    return passes if passes <= 3 else 4 if passes <= 7 else 5


def edge_blurred(pixels: DataFrame, passes: int) -> DataFrame:
    """The 3 x 3 blur with weights 1 2 1, ``passes`` times (at most 127): all but the last at a quarter of the depth.

    A mask is given room once, by the number of passes; what would spread further stops at the edge, which repeats.
    """
    passes = max(0, min(127, passes))
    if not passes:
        return pixels

    def once(rows: DataFrame) -> DataFrame:
        return rows.withColumn("v", weighted("v", along(True))).withColumn("v", F.shiftright(weighted("v", along(False)), 4).cast("int"))

    pixels = padded(pixels, edge_room(passes), edge_room(passes))
    if passes > 1:
        pixels = pixels.withColumn("v", F.shiftright(F.shiftright("v", 1) + 1, 1))
        for _ in range(passes - 1):
            pixels = once(pixels)
        pixels = pixels.withColumn("v", (F.col("v") * 4 - (F.col("v") > 32).cast("int")).bitwiseAND(F.lit(255)))
    return once(pixels)


def box_radii(sigma: float) -> list[int]:
    """Radii of three boxes that come nearest to a Gaussian."""
    spread = 12 * sigma * sigma
    small = math.floor(math.sqrt(spread / 3 + 1))
    small -= small % 2 == 0
    smaller = math.floor((spread - 3 * small * small - 12 * small - 9) / (-4 * small - 4) + 0.5)
    return [(max(1, small if i < smaller else small + 2) - 1) // 2 for i in range(3)]


def boxes(masks: np.ndarray, radii: list[tuple[int, int]]) -> np.ndarray:
    """Masks (mask, y, x) through pairs of boxes, across and down, each cut to a whole number; outside is zero."""
    for pair in radii:
        for r, axis in zip(pair, (2, 1)):
            if r:
                room = [(0, 0)] * 3
                room[axis] = (r + 1, r)
                sums = np.cumsum(np.pad(masks, room), axis=axis)
                n = sums.shape[axis]
                total = np.take(sums, range(2 * r + 1, n), axis=axis) - np.take(sums, range(n - 2 * r - 1), axis=axis)
                masks = np.sign(total) * (np.abs(total) // (2 * r + 1))
    return masks


def gaussian_blurred(pixels: DataFrame, sigma_x: float, sigma_y: float) -> DataFrame:
    """A Gaussian blur by three boxes an axis, each cut to a whole number; the mask grows by twice the spread.

    The pixels of a mask are brought together once, without the room around them; a mask is a task's unit of work.
    """
    if sigma_x <= 0 and sigma_y <= 0:
        return pixels
    across, down = (max(0.0, s) for s in (sigma_x, sigma_y))
    wide, high = (math.ceil(across) + 1) * 2, (math.ceil(down) + 1) * 2
    radii = list(zip(box_radii(across), box_radii(down)))
    kept = pixels.select("mask", "x", "y", F.coalesce("v", F.lit(0)).cast("int").alias("v"))
    arrow = to_arrow_schema(kept.schema)

    def blurred(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole masks, those of one size at once."""
        ends = pc.run_end_encode(rows["mask"].combine_chunks()).run_ends.to_numpy()
        starts = np.concatenate([[0], ends[:-1]])
        x, y, v = (rows[c].to_numpy().astype(np.int64) for c in ("x", "y", "v"))
        x0, y0 = (np.minimum.reduceat(c, starts) for c in (x, y))
        w, h = (np.maximum.reduceat(c, starts) - c0 + 1 + 2 * more for c, c0, more in ((x, x0, wide), (y, y0, high)))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        for size in set(zip(h.tolist(), w.tolist())):
            own = np.flatnonzero((h == size[0]) & (w == size[1]))
            place = np.full(len(starts), -1)
            place[own] = np.arange(len(own))
            r = np.flatnonzero(place[of] >= 0)
            grid = np.zeros((len(own), *size), np.int64)
            grid[place[of[r]], y[r] - y0[of[r]] + high, x[r] - x0[of[r]] + wide] = v[r]
            out = boxes(grid, radii)
            n = size[0] * size[1]
            columns = {
                "mask": rows["mask"].combine_chunks().take(pa.array(np.repeat(starts[own], n))),
                "x": (np.arange(size[1])[None, None, :] + (x0[own] - wide)[:, None, None] + np.zeros((1, size[0], 1), np.int64)).ravel(),
                "y": (np.arange(size[0])[None, :, None] + (y0[own] - high)[:, None, None] + np.zeros((1, 1, size[1]), np.int64)).ravel(),
                "v": out.ravel(),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name == "mask" else pa.array(columns[f.name]).cast(f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last mask so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.run_end_encode(batch["mask"]).run_ends
            at = ends[-2].as_py() if len(ends) > 1 else 0
            if not at and held and held[-1]["mask"][-1] != batch["mask"][0]:
                yield from blurred(pa.Table.from_batches(held))
                held = []
            elif at:
                yield from blurred(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from blurred(pa.Table.from_batches(held))

    return kept.repartition("mask").sortWithinPartitions("mask").mapInArrow(run, kept.schema)


def is_seen(opacity: Column, x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """Whether an overlay of w x h at (x, y) shows on a frame: not transparent, and some of it inside."""
    return (alpha_fixed(opacity) > 0) & (x < frame_w) & (y < frame_h) & (x + w > 0) & (y + h > 0)
