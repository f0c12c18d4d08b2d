"""Stamps as a container's writer leaves them: rescaled, guessed and repaired on what was written before.

A packet's written dts depends on the one written before it, and a copied sound packet's also on where its stream's samples
stand. Both are small functions of a state; ``scans.scanned`` composes them a cell at a time, so that a stream is not one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoframe.functions.rational import rescale
from kinoframe.operators.scan import STREAM
from kinoframe.operators.scans import CELL, Rising, scanned

#: No dts: less than any, and it stays so when something is added.
NONE = -(1 << 63)


def up(x: int) -> int:
    return x if x == NONE else x + 1


class Written:
    """The dts written last (``NONE``: none), in a list so that a step can change it."""

    def __init__(self, dts: int = NONE):
        self.dts = dts

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Written) and other.dts == self.dts


def repaired(last: Written, pts: int | None, dts: int | None, timed: bool, strict: bool) -> tuple[int | None, int | None]:
    """What a packet is written with.

    A dts after its pts is a mistake: both become the median of pts, dts and the place after the last dts. Of sound, pictures
    and subtitles (``timed``) the dts then has to lie after the last one (not ``strict``: not before it), and a pts that was not
    before the dts follows it. A missing dts stays missing, and the packet after it begins anew.
    """
    if dts is None:
        last.dts = NONE
        return pts, dts
    due = up(last.dts)
    if pts is not None and dts > pts:
        pts = dts = sorted((pts, dts, due))[1]
    least = due if strict else last.dts
    if timed and last.dts != NONE and dts < least:
        pts = pts if pts is None or pts < dts else max(pts, least)
        dts = least
    last.dts = dts
    return pts, dts


class Steps(Rising):
    """Repairs of a row of packets as one function of the dts written before them.

    A strict packet adds one for all, a guess of a lenient one only for those that come out below its dts. ``high`` bounds a
    stream that is not timed, and one that begins anew.
    """

    def __init__(self):
        super().__init__(NONE)
        self.high: int | None = None

    def then(self, pts: int | None, dts: int | None, timed: bool, strict: bool) -> None:
        if dts is None:
            self.low = self.high = NONE
            self.places = []
            return
        guess = pts is not None and dts > pts
        if timed and strict:
            self.shift += 1
            self.low = max(up(self.low), pts if guess else dts)
            self.high = None if self.high is None else max(up(self.high), pts if guess else dts)
        elif timed:
            if guess and self.low < dts:
                if self.high is None:
                    self.one_more_below(dts)
                self.low = up(self.low)
            self.low = max(self.low, pts if guess else dts)
            self.high = None if self.high is None else self.low  # a lenient stream is bounded above after a gap alone
        elif guess:
            self.shift += 1
            self.low = min(max(up(self.low), pts), dts)
            self.high = dts if self.high is None else min(max(up(self.high), pts), dts)
        else:
            self.low = self.high = dts
        if self.high == self.low:
            self.places = []
        elif self.low != NONE:
            self.pruned()

    def after(self, state: Written) -> Written:
        x = self.low if state.dts == NONE else self.of(state.dts)
        return Written(x if self.high is None else min(x, self.high))


def nearest(n: int, d: int) -> int:
    """n / d rounded, halves away from zero."""
    return (2 * abs(n) + d) // (2 * d) * (1 if n >= 0 else -1)


class Span:
    """Where a sound packet can lie, in samples: from ``low`` to ``high`` by its coarse stamp, ``sure`` by the stamp alone.

    The place that the samples before it lead to is taken, moved into that range, unless it lies further out than the range
    is wide, or the stamp is as fine as the output's.
    """

    def __init__(self, dts: int, num: int, den: int, rate: int, samples: int, out_num: int, out_den: int):
        self.sure, self.samples = nearest(dts * num * rate, den), samples
        self.coarse = bool(samples) and num * out_den > out_num * den
        self.low = ((2 * dts - 1) * num * rate // den) >> 1
        self.high = (-(-(2 * dts + 1) * num * rate // den) + 1) >> 1

    def takes(self, due: int | None) -> bool:
        return self.coarse and due is not None and 2 * self.low - self.high <= due <= 2 * self.high - self.low


class Sound:
    """Where the samples of a copied stream stand: the place the next packet is due, in samples."""

    def __init__(self, due: int | None = None):
        self.due = due

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sound) and other.due == self.due


def placed_sound(sound: Sound, dts, num, den, rate, samples, out_num, out_den) -> tuple[int | None]:
    """A sound packet's dts in ticks of the output; one without a dts stays so, and what is due does not change."""
    if dts is None:
        return (None,)
    span = Span(dts, num, den, rate, samples, out_num, out_den)
    if span.takes(sound.due):
        at = min(max(sound.due, span.low), span.high)
        out = nearest(at * out_den, rate * out_num)
    else:
        at, out = span.sure, nearest(dts * num * out_den, den * out_num)
    sound.due = at + samples
    return (out,)


class Remainder:
    """Sound packets as one function of the place due before them.

    After the first packet a place is one of few: those of its range, or the one its stamp is sure of. What becomes of each is
    kept; they meet sooner or later, and then one number is left.
    """

    def __init__(self):
        self.first: Span | None = None
        self.places: np.ndarray | None = None  # by first place; None: whatever came before leads to ``alone``
        self.alone = 0

    def then(self, dts, num, den, rate, samples, out_num, out_den) -> None:
        if dts is None:
            return
        span = Span(dts, num, den, rate, samples, out_num, out_den)
        if self.first is None:
            self.first, self.alone = span, span.sure + samples
            self.places = np.arange(span.low, span.high + 1) + samples if span.coarse else None
            return
        self.alone = (min(max(self.alone, span.low), span.high) if span.takes(self.alone) else span.sure) + samples
        if self.places is not None:
            if span.coarse:
                near = (self.places >= 2 * span.low - span.high) & (self.places <= 2 * span.high - span.low)
                self.places = np.where(near, np.clip(self.places, span.low, span.high), span.sure) + samples
            if not span.coarse or (self.places == self.alone).all():
                self.places = None

    def after(self, state: Sound) -> Sound:
        if self.first is None:
            return Sound(state.due)
        if self.places is None or not self.first.takes(state.due):
            return Sound(self.alone)
        return Sound(int(self.places[min(max(state.due, self.first.low), self.first.high) - self.first.low]))


def muxed(packets: DataFrame, strict: bool = True, stamps: bool = True, cell: int = CELL) -> DataFrame:
    """Packets (pts, dts, duration in ticks of num/den) with ``out_pts``, ``out_dts``, ``out_duration`` in ticks of out_num/out_den,
    as they are written, in order of ``seq`` in each stream.

    ``kind``: audio, video, subtitle or other; ``copied`` sound has its samples counted (``sample_rate``, ``samples``) and its pts is
    its dts. ``stamps`` false: the container holds none, and nothing is repaired.
    """
    ticks = lambda c: rescale(F.col(c), F.col("num").cast("long") * F.col("out_den"), F.col("den").cast("long") * F.col("out_num")).cast("long")
    rows = packets.withColumn("out_duration", ticks("duration"))
    is_sound = F.coalesce((F.col("kind") == "audio") & F.col("copied"), F.lit(False))
    plain = rows.where(~is_sound).withColumn("_dts", ticks("dts")).withColumn("_pts", ticks("pts"))
    inputs = ["dts", "num", "den", "sample_rate", "samples", "out_num", "out_den"]
    sound = scanned(rows.where(is_sound), [STREAM], inputs, Sound, placed_sound, "_dts long", cell=cell, carry=Remainder).withColumn("_pts", F.col("_dts"))
    both = plain.unionByName(sound)
    if not stamps:
        return both.withColumnsRenamed({"_pts": "out_pts", "_dts": "out_dts"})
    timed = F.coalesce(F.col("kind").isin("audio", "video", "subtitle"), F.lit(False))
    both = both.withColumn("_timed", timed).withColumn("_strict", F.lit(strict))
    done = scanned(both, [STREAM], ["_pts", "_dts", "_timed", "_strict"], Written, repaired, "out_pts long, out_dts long", cell=cell, carry=Steps, like=packets)
    return done.drop("_pts", "_dts", "_timed", "_strict")
