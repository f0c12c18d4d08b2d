"""Timing of packets and decoded frames: predicted stamps, durations, time bases.

A prediction that builds on the one before it is a sum since the last stamp that was there. Stamps and durations of frames, which
build on each other, are a fold over cells (``scans.scanned``); the clock of sound, whose remainder never ends, carries its
state along a stream (``folds.folded``).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions.rational import MICROS, rescale_q
from kinoframe.operators.folds import folded
from kinoframe.operators.scan import STREAM, ordered, upto
from kinoframe.operators.scans import CELL, scanned

#: A time base that holds all common sample rates, for when their common multiple is too large.
COMMON_RATE = 28_224_000
INT_MAX = (1 << 31) - 1


def nearest(n: int, d: int) -> int:
    """n / d rounded, halves away from zero."""
    return (2 * abs(n) + d) // (2 * d) * (1 if n >= 0 else -1)


def islands_of(known: Column) -> Column:
    """Number of known values so far: what follows one belongs to it."""
    return F.sum(known.cast("int")).over(upto(ordered()))


def predicted_dts(packets: DataFrame, delay_us: int = 0, rate: tuple[int, int] | None = None) -> DataFrame:
    """``dts_us`` of packets in microseconds, given or predicted, as ``out_us``.

    A packet without a dts comes where the one before it ends: its dts plus its duration, or with ``rate`` (frames a second)
    one place on that rate's grid. A stream that begins without a dts begins at its first pts less ``delay_us``.
    """
    w = upto(ordered())
    first = F.first(F.coalesce("pts_us", F.lit(0)) - delay_us).over(w)
    rows = packets.withColumn("_island", islands_of(F.col("dts_us").isNotNull())).withColumn("_known", F.coalesce(F.last("dts_us", ignorenulls=True).over(w), first))
    island = Window.partitionBy(STREAM, "_island").orderBy("seq")
    if rate:
        place = F.row_number().over(island) - 1
        grid = rescale_q(F.col("_known"), 1, MICROS, rate[1], rate[0]) + place
        out = F.when(place == 0, F.col("_known")).otherwise(rescale_q(grid.cast("long"), rate[1], rate[0], 1, MICROS))
    else:
        out = F.col("_known") + F.coalesce(F.sum("duration_us").over(island.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("out_us", out.cast("long")).drop("_island", "_known")


@dataclass
class Shown:
    """The stamp of the last frame, and how long it is taken to last."""

    pts: int | None = None
    lasts: int = 0

    def take(self, pts: int | None, duration: int | None, steady: int, forced: bool) -> tuple[int, int]:
        """A frame's stamp and duration. A missing stamp is where the frame before it ends; forced frames all have none, and last 1.

        The duration is, in order: the frame's own (unless it is 1 and the step from the frame before is over 2), that step, the
        frame's own after all, ``steady``, the last estimate, 1.
        """
        pts, duration = (None, 1) if forced else (pts, duration or 0)
        pts = pts if pts is not None else 0 if self.pts is None else self.pts + self.lasts
        moved = -1 if self.pts is None else pts - self.pts
        sure = forced or duration > 0 and not (duration == 1 and moved > 2)
        self.lasts = duration if sure else next((x for x in (moved, duration, steady, self.lasts) if x > 0), 1)
        self.pts = pts
        return pts, self.lasts


def timed_frames(frames: DataFrame, rate_ticks: int = 0, stream_ticks: int = 0, forced: bool = False, cell: int = CELL) -> DataFrame:
    """Decoded frames (pts and duration in ticks, either may be missing) with ``out_pts`` and ``estimate``, their duration.

    One recurrence: a missing stamp builds on the last estimate, and the next estimate on that stamp. ``rate_ticks`` is the
    codec's duration of a frame, ``stream_ticks`` that of the stream's mean rate.
    """
    steady = rate_ticks if rate_ticks > 0 else stream_ticks
    return scanned(frames, [STREAM], ["pts", "duration"], Shown, lambda s, pts, duration: s.take(pts, duration, steady, forced), "out_pts long, estimate long", cell=cell)


def output_base(kind: Column, sample_rate: Column, num: Column, den: Column, most_num: Column, most_den: Column, mode: Column, tb_num: Column, tb_den: Column) -> Column:
    """Rate and time base of a filtered stream.

    Sound takes its sample rate. Pictures take the inverse of their rate, which constant rates default to 25 and hold at
    most at ``most``; where there is none, the frame's own base.
    """
    steady = mode.isin("cfr", "vscfr")
    missing = steady & (num == 0) & (most_num == 0)
    n, d = F.when(missing, 25).otherwise(num), F.when(missing, 1).otherwise(den)
    over = steady & (most_num != 0) & ((d == 0) | (n.cast("double") * most_den > most_num.cast("double") * d))
    n, d = F.when(over, most_num).otherwise(n), F.when(over, most_den).otherwise(d)
    good = (n > 0) & (d > 0)
    base = lambda a, b: F.struct(a.cast("int").alias("num"), b.cast("int").alias("den"))
    return F.when(kind == "audio", base(F.lit(1), sample_rate)).when(good, base(d, n)).otherwise(base(tb_num, tb_den))


def fine_pts(pts: Column, from_num: int, from_den: int, to_num: int, to_den: int, start_us: int = 0) -> Column:
    """A stamp in an encoder's base as a double, with up to 16 bits more than the base holds; what is no whole number moves
    2^-17 away from zero, so that halves round the same on both sides of it."""
    extra = max(0, min(16, 29 - (to_den.bit_length() - 1)))
    den = to_den << extra
    fine = rescale_q(pts, from_num, from_den, to_num, den).cast("double") - rescale_q(F.lit(start_us).cast("long"), 1, MICROS, to_num, den).cast("double")
    fine = fine / float(1 << extra)
    return F.when(fine != F.rint(fine), fine + F.signum(fine) / float(1 << 17)).otherwise(fine)


def common_rates(frames: DataFrame) -> DataFrame:
    """Where a stream's sample rate changes: (stream_index, seq, sample_rate, base), ``base`` the ticks a second that hold
    the stamps of all rates so far: their common multiple, or ``COMMON_RATE`` where that is too large.

    Only changes are gathered by stream; frames between them are not.
    """
    changed = frames.withColumn("_before", F.lag("sample_rate").over(ordered())).where("_before IS NULL OR _before <> sample_rate").select(STREAM, "seq", "sample_rate")

    def step(clock: Clock, rate: int) -> tuple[int]:
        clock.change(rate)
        return (clock.base,)

    return folded(changed, [STREAM], ["seq"], ["sample_rate"], Clock, step, "base long")


@dataclass
class Clock:
    """The clock of a stream of sound: its ticks a second, the last frame's place on it, and where the next one is due."""

    base: int = 1
    rate: int | None = None
    last: int | None = None
    length: int = 0
    due: int | None = None

    def change(self, rate: int, num: int = 0, den: int = 1) -> None:
        """Takes up another sample rate: what is known moves to the base that also holds its stamps, which is that of the
        frame (num/den seconds a tick) if it is finer."""
        before = self.base
        share = before // gcd(before, rate)
        self.base = COMMON_RATE if share >= INT_MAX // rate else share * rate
        if num == 1 and den > self.base and den % self.base == 0:
            self.base = den
        self.last = None if self.last is None else nearest(self.last * self.base, before)
        self.length = nearest(self.length * self.base, before)
        self.rate = rate

    def stamp(self, pts: int | None, num: int, den: int, rate: int, samples: int) -> int:
        """Where a frame of ``samples`` samples lies, in samples of its rate.

        ``pts`` counts num/den seconds. Where it agrees with the end of the frame before it to half a tick, that end is
        taken, which is finer; where it does not, or lies after a gap, the clock is set by it anew.
        """
        if rate != self.rate:
            self.change(rate, num, den)
        expected = 0 if self.last is None else self.last + self.length
        if pts is None:
            pts, num, den = expected, 1, self.base
        elif self.last is not None and pts > -(-expected * den // (self.base * num)):
            self.due = None
        at = nearest(pts * num * self.base, den)
        if self.due is not None and samples and num * self.base > den:
            low = ((2 * pts - 1) * num * self.base // den) >> 1
            high = (-(-(2 * pts + 1) * num * self.base // den) + 1) >> 1
            if 2 * low - high <= self.due <= 2 * high - low:
                at = min(max(self.due, low), high)
        self.due = at + samples
        self.last, self.length = at, nearest(samples * self.base, rate)
        return nearest(at * rate, self.base)


def sound_stamps(frames: DataFrame) -> DataFrame:
    """Frames of sound (pts in ticks of num/den seconds, sample_rate, samples) with ``out_pts`` in samples of their rate."""
    inputs = ["pts", "num", "den", "sample_rate", "samples"]
    return folded(frames, [STREAM], ["seq"], inputs, Clock, lambda clock, *frame: (clock.stamp(*frame),), "out_pts long")


def wrap_corrected(packets: DataFrame, start: Column, bits: int) -> DataFrame:
    """Stamps of a counter of ``bits`` bits that began at ``start``: what lies over half the range after it lay before it.

    That holds for the packets in front of a stream, up to the first one that has no such stamp.
    """
    turn, far = 1 << bits, lambda c: F.coalesce(F.col(c) > start + (1 << bits - 1), F.lit(False))
    done = F.coalesce(F.max((~(far("pts") | far("dts"))).cast("int")).over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    back = lambda c: F.when(~F.col("_done") & far(c), F.col(c) - turn).otherwise(F.col(c))
    rows = packets.withColumn("_done", done)
    return rows.withColumn("out_pts", back("pts")).withColumn("out_dts", back("dts")).drop("_done")
