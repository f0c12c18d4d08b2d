"""Chains of frame filters over streams: what a filter remembers, what it hands on, and what it puts out by itself.

A filter is a small dataclass (its fields are its memory, which is pickled and compared). All filters of a chain share a map of
attributes. A stream is folded in cells (``scans``), so a chain that forgets what lies far behind is not one task a stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinoframe.operators.scan import STREAM
from kinoframe.operators.scans import CELL, scanned

Frame = dict[str, Any]


@dataclass
class Filter:
    """Base: a filter that lets every frame pass. Attributes are shared by the chain."""

    def start(self, shared: dict[str, Any]) -> None:
        """Before the first frame of a stream."""

    def frame(self, shared: dict[str, Any], frame: Frame) -> Frame | None:
        """A frame in, a frame out; None drops it."""
        return frame

    def more(self, shared: dict[str, Any], ended: bool) -> Frame | None:
        """A frame of the filter's own; asked for after every frame and, ``ended``, after the last, until there is none."""
        return None


@dataclass
class Chain:
    filters: list[Filter]
    shared: dict[str, Any] = field(default_factory=dict)
    begun: bool = False

    def onward(self, frame: Frame | None, at: int) -> list[Frame]:
        """What comes out at the end of a frame that goes into filter ``at``."""
        for f in self.filters[at:]:
            frame = None if frame is None else f.frame(self.shared, frame)
        return [] if frame is None else [frame]

    def asked(self, ended: bool) -> list[Frame]:
        """What the filters have by themselves, each taken through those behind it."""
        self.open()
        out = []
        for i, f in enumerate(self.filters):
            while (own := f.more(self.shared, ended)) is not None:
                out += self.onward(own, i + 1)
        return out

    def open(self) -> None:
        if not self.begun:
            self.begun = True
            for f in self.filters:
                f.start(self.shared)

    def take(self, frame: Frame) -> list[Frame]:
        self.open()
        return self.onward(frame, 0) + self.asked(False)


def filtered(frames: DataFrame, filters: Callable[[], list[Filter]], columns: list[str], schema: str, by: str = STREAM, cell: int = CELL) -> DataFrame:
    """What a chain puts out of each stream: ``by``, ``seq`` of the frame that led to it (null: the end), ``part`` and the fields of
    ``schema``. ``columns`` are what filters see of a frame; ``filters`` makes a stream's chain."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    shown = lambda found: ([{n: f.get(n) for n in names} for f in found],)
    out = scanned(
        frames.select(by, "seq", *[c for c in columns if c not in (by, "seq")]),
        [by], columns, lambda: Chain(filters()), lambda chain, *values: shown(chain.take(dict(zip(columns, values)))),
        f"out array<struct<{', '.join(f'{x.strip().split()[0]}: {x.strip().split()[1]}' for x in schema.split(','))}>>",
        cell=cell, finish=lambda chain: [shown(chain.asked(True))],
    )
    return out.select(by, "seq", F.posexplode("out").alias("part", "f")).select(by, "seq", "part", "f.*")
