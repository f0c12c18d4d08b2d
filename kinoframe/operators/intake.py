"""Stamps of packets as they are read: wraps, offsets, scale, loops, jumps, strays and the dts that is expected next.

One fold over an asset's packets in order of arrival, as a jump that one stream shows is taken out of all. What it remembers
is kept in the input's own time, and the offset apart from it: a cell that is folded without the jumps before it differs
from the truth by that offset alone, so cells are speculated (``scans``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kinoframe.functions.rational import MICROS
from kinoframe.operators.scan import STREAM
from kinoframe.operators.scans import CELL, scanned

#: How far a stamp may lie from where it is expected, and before its stream's last one, in formats whose stamps may jump; and
#: how far in all others.
FAR, BACK, STRAY = 10 * MICROS, MICROS // 10, 108_000 * MICROS


def nearest(n: int, d: int) -> int:
    """n / d rounded, halves away from zero."""
    return (2 * abs(n) + d) // (2 * d) * (1 if n >= 0 else -1)


@dataclass
class Stream:
    """A stream's last dts and the next one expected, in input time; whether its counter has come past its wrap."""

    last: int | None = None
    due: int | None = None
    whole: bool = False


@dataclass
class Intake:
    """``offset`` takes all jumps so far out again. ``pinned``: what is known depends on it, as a stamp was made of nothing or of
    a grid of frames, not of a stamp."""

    streams: dict[int, Stream] = field(default_factory=dict)
    last: int = 0
    pinned: bool = False
    offset: int = field(default=0, compare=False)


def moved(entry: Intake, left: Intake, state: Intake) -> Intake | None:
    """What a cell that leaves ``left`` from ``entry`` leaves from a state that may differ in its offset."""
    if state.offset != entry.offset and (state.pinned or left.pinned):
        return None
    return Intake(left.streams, left.last, left.pinned, left.offset + state.offset - entry.offset)


@dataclass(frozen=True)
class Rules:
    """``start_us`` and ``turn_us``: where the container begins and after how long its counter wraps; ``copyts``: only wraps are taken
    out; ``jumps``: a format whose stamps may jump; ``rate``: frames a second that are forced on pictures, as two numbers."""

    start_us: int | None = None
    turn_us: int | None = None
    shift_us: int = 0
    scale: float = 1.0
    loop_us: int = 0
    copyts: bool = False
    jumps: bool = True
    rate: tuple[int, int] | None = None

    def read(self, s: Stream, stamps: list[int | None]) -> list[int | None]:
        """Stamps without wraps, shifted, scaled and moved to their pass of a loop. A stamp over half a turn after the start lay
        before it, as long as a stream has only such."""
        if self.start_us is not None and self.turn_us and not s.whole:
            early = [x is not None and x > self.start_us + self.turn_us // 2 for x in stamps]
            s.whole = not any(early)
            stamps = [x - self.turn_us if e else x for x, e in zip(stamps, early)]
        stamps = [x if x is None else x + self.shift_us for x in stamps]
        if self.scale != 1.0:
            stamps = [x if x is None else int(x * self.scale) for x in stamps]
        return [x if x is None else x + self.loop_us for x in stamps]

    def jump(self, state: Intake, s: Stream, dts: int) -> int:
        """How far a stamp lies off where its stream is expected, or for a stream's first where the asset has come, if that is a
        jump. All in input time, where the offset cancels out."""
        if s.due is None:
            off = 0 if self.copyts else dts - state.last
            return off if abs(off) > FAR else 0
        off = dts - s.due
        wraps = bool(self.turn_us) and abs(off + self.turn_us) < abs(off) // 10
        if self.copyts and not wraps:
            return 0
        return off if abs(off) > FAR or dts + BACK < s.last else 0

    def packet(self, state: Intake, stream: int, kind: str, dts: int | None, pts: int | None, duration: int | None, frame_size: int | None, sample_rate: int | None, rate_num: int | None, rate_den: int | None, delay_us: int | None) -> tuple:
        """(dts, pts, expected dts, offset) of a packet."""
        s = state.streams.setdefault(stream, Stream())
        dts, pts = self.read(s, [dts, pts])
        timed = kind in ("audio", "video")
        if timed and dts is not None and self.jumps:
            off = self.jump(state, s, dts)
            if off:
                state.offset -= off
                for other in state.streams.values():  # what the others expect stays where it is in the output
                    other.last, other.due = (x if x is None else x + off for x in (other.last, other.due))
            state.last = dts
        elif timed and dts is not None and not self.copyts and s.due is not None:
            dts, pts = (x if x is not None and abs(x - s.due) <= STRAY else None for x in (dts, pts))
        self.expect(state, s, kind, dts, pts, duration or 0, frame_size, sample_rate, rate_num, rate_den, delay_us or 0)
        out = [x if x is None else x + state.offset for x in (dts, pts, s.last)]
        return (*out, state.offset)

    def expect(self, state, s, kind, dts, pts, duration, frame_size, sample_rate, rate_num, rate_den, delay_us) -> None:
        """A stream's dts, and the next: after sound's frame size, after a picture of the forced, own or codec's rate."""
        if s.due is None:
            s.due = (pts if pts is not None else -state.offset) - delay_us
            state.pinned |= pts is None and dts is None
        s.last = s.due if dts is None else dts
        if kind == "audio":
            s.due = s.last + (MICROS * (frame_size or 0) // sample_rate if sample_rate else duration)
        elif kind == "video" and self.rate:
            num, den = self.rate
            tick = nearest((s.last + state.offset) * num, MICROS * den) + 1
            s.due = nearest(tick * MICROS * den, num) - state.offset
            state.pinned = True
        elif kind == "video":
            s.due = s.last + (duration or (nearest(MICROS * rate_den, rate_num) if rate_num and rate_den else 0))
        else:
            s.due = s.last


COLUMNS = [STREAM, "kind", "dts_us", "pts_us", "duration_us", "frame_size", "sample_rate", "rate_num", "rate_den", "delay_us"]


def taken_in(packets: DataFrame, rules: Rules = Rules(), cell: int = CELL) -> DataFrame:
    """Packets of assets with ``out_dts``, ``out_pts``, ``expected_us`` (their dts, or where it would be) and ``offset_us``.

    Columns: asset_id, seq (arrival), stream_index, kind, dts_us, pts_us, duration_us, and of their streams frame_size, sample_rate,
    rate_num, rate_den (the codec's pictures a second) and delay_us (how far a first dts lies before its pts).
    """
    schema = "out_dts long, out_pts long, expected_us long, offset_us long"
    return scanned(packets, ["asset_id"], COLUMNS, Intake, rules.packet, schema, cell=cell, moved=moved)
