"""Rate conversion: how often each frame is put out at an output's rate, to the end of the stream.

Stamps and durations are whole millionths of an output tick, so that thresholds are met exactly. With a constant rate the
output's place after a frame is a small function of the place before it, and cells of a stream are composed; the other
modes follow the input's stamps, which makes them forget where they stood, and their cells are speculated (``scans``).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.rational import MICROS
from kinoframe.operators.scan import STREAM, ordered, upto
from kinoframe.operators.scans import CELL, Rising, same, scanned

#: A frame that would be repeated more often has a broken stamp and is left out.
MOST = 3_240_000


class Mode(NamedTuple):
    """Drift of a frame's end against the output, in millionths of a tick: at which frames are dropped, beyond which a constant
    rate repeats them, and from which else the output follows a frame's stamp."""

    constant: bool
    drop: int
    beyond: int
    clips: bool = True


# The thresholds of the drift.
MODES = {
    "cfr": Mode(True, -1_100_001, 1_100_000),
    "vscfr": Mode(True, -1_100_001, 1_100_000),
    "vfr": Mode(False, -600_000, 600_000),
    "passthrough": Mode(False, -(1 << 62), -(1 << 62), clips=False),
}
#: How late a repeated frame's begin must be for copies of the frame before it, and how much of that is not made up by them.
LATE, KEPT = 1_100_000, 600_000


def rounded(x: int) -> int:
    """Millionths as whole ticks, halves away from zero."""
    return (abs(x) + MICROS // 2) // MICROS * (1 if x >= 0 else -1)


@dataclass
class Output:
    """The output's next tick, whether its first frame keeps its own stamp and is still to come, and how many copies of their
    predecessors the last three frames took."""

    next: int = 0
    waits: bool = False
    history: tuple[int, int, int] = (0, 0, 0)

    def take(self, at: int, length: int, mode: Mode) -> tuple[int, int]:
        """Copies of a frame, and how many of them show the frame before it."""
        begin = at - self.next * MICROS
        end = begin + length
        if mode.clips and begin < 0 < end:
            at, begin = self.next * MICROS, 0
        if self.waits and 2 * begin >= MICROS:
            self.next, begin, end = rounded(at), 0, length
        copies, before = int(end > mode.drop), 0
        if end > mode.beyond and mode.constant:
            copies, before = rounded(end), rounded(begin - KEPT) if begin > LATE else 0
        elif end > mode.beyond:
            self.next = rounded(at)
        self.history = (before, *self.history[:2])
        copies = copies if copies <= MOST else 0
        self.next += copies
        self.waits = self.waits and not copies
        return copies, min(before, copies)

    def end(self) -> list[tuple[int, int]]:
        """After the last frame it is shown as often as the median of what the last three frames gave their predecessors."""
        more = sorted(self.history)[1]
        return [(more, more)] if 0 < more <= MOST else []


class Ticks:
    """Frames at a constant rate as one function of the output's place; the last three are taken one by one, for their history."""

    def __init__(self):
        self.function, self.least, self.rest = Rising(-(1 << 62)), -(1 << 62), deque()

    def then(self, at: int, length: int) -> None:
        self.rest.append((at, length))
        if len(self.rest) > 3:
            at, length = self.rest.popleft()
            end, f = at + length, self.function
            far = rounded(end) if end >= 0 else -((-2 * end + MICROS - 1) // (2 * MICROS))  # what all come to that lie far before it
            if f.low < far - MOST:
                self.least = max(self.least, f.reach(far - MOST))
            below = (end - MODES["cfr"].drop - 1) // MICROS + 1
            if f.low < below:
                f.one_more_below(below)
                f.low += 1
            f.low = max(f.low, far)
            f.pruned()

    def after(self, state: Output) -> Output | None:
        if state.waits or state.next < self.least:
            return None
        out = Output(self.function.of(state.next), False, state.history)
        for at, length in self.rest:
            out.take(at, length, MODES["cfr"])
        return out


def fold(frames: list[tuple[int, int]], mode: str) -> list[tuple[int, int]]:
    """(copies, before) of all frames (stamp and duration in millionths of a tick) of a stream, then those at its end."""
    out = Output(waits=mode == "vscfr")
    return [out.take(at, length, MODES[mode]) for at, length in frames] + out.end()


def synced(frames: DataFrame, mode: str, fps: int, cell: int = CELL) -> DataFrame:
    """Frames with ``copies`` and ``before`` (copies that show the frame before) at an output rate of ``fps``; a row without
    ``seq`` ends a stream whose last frame is shown again."""
    rule, waits = MODES[mode], mode == "vscfr"
    first = frames.groupBy(STREAM).agg(F.min_by("pts_us", "seq").alias("_first"))
    rows = frames.join(first, same(frames, first, [STREAM])).drop(first[STREAM])
    rows = rows.withColumn("_at", (F.col("pts_us") - F.col("_first")) * fps).withColumn("_length", F.col("duration_us") * fps).drop("_first")
    done = scanned(rows, [STREAM], ["_at", "_length"], lambda: Output(waits=waits), lambda out, at, length: out.take(at, length, rule), "copies long, before long", cell=cell, carry=Ticks if rule.constant else None, finish=Output.end)
    return done.drop("_at", "_length")


def emitted(frames: DataFrame) -> DataFrame:
    """Frames of ``synced`` as they are put out: (stream_index, tick, seq), ``seq`` the frame shown; the first ``before`` of
    a frame's copies show the frame before it."""
    w = ordered(F.col("seq").asc_nulls_last())
    rows = frames.withColumn("_prev", F.coalesce(F.lag("seq").over(w), F.col("seq"))).withColumn("_first", F.sum("copies").over(upto(w)) - F.col("copies")).where("copies > 0")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select(STREAM, (F.col("_first") + F.col("_k")).alias("tick"), F.when(F.col("_k") < F.col("before"), F.col("_prev")).otherwise(F.col("seq")).alias("seq"))


def sync_mode(asked: Column, variable_rate: Column, stamps: Column) -> Column:
    """The mode that ``auto`` stands for, by what the container can hold: frames at any time, or no stamps at all."""
    own = F.when(~variable_rate, "cfr").when(stamps, "vfr").otherwise("passthrough")
    return F.when(asked == "auto", own).otherwise(asked)
