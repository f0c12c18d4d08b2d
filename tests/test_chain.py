"""Chains of filters: shared attributes, frames at the end, and cells of any size."""

import random
from dataclasses import dataclass, field

from kinoframe.operators import chain


@dataclass
class Counts(chain.Filter):
    """Tells the others how many frames have come."""

    seen: int = 0

    def start(self, shared):
        shared["seen"] = 0

    def frame(self, shared, frame):
        self.seen += 1
        shared["seen"] = self.seen
        return frame


@dataclass
class Pairs(chain.Filter):
    """Holds frames back and puts out sums of two, the last alone at the end."""

    held: list = field(default_factory=list)

    def frame(self, shared, frame):
        self.held.append(frame["size"])
        return None

    def more(self, shared, ended):
        if len(self.held) >= 2 or ended and self.held:
            part, self.held = self.held[:2], self.held[2:]
            return {"size": sum(part)}


@dataclass
class Marks(chain.Filter):
    """Reads what an earlier filter set."""

    def frame(self, shared, frame):
        return None if frame["size"] % 7 == 0 else {**frame, "place": shared["seen"]}


def makes():
    return [Counts(), Pairs(), Marks()]


def test_filters_share_attributes_and_flush_at_the_end(spark):
    pick = random.Random(4)
    rows = [(s, i, pick.randrange(50)) for s in (None, 1, 2) for i in range(23)]
    df = spark.createDataFrame(rows, "stream_index long, seq long, size long")
    want = []
    for s in (None, 1, 2):
        own = [n for t, _, n in rows if t == s]
        for i in range(0, 23, 2):
            total = sum(own[i : i + 2])
            if total % 7:
                want.append((s, i + 1 if i + 1 < 23 else None, 0, total, min(i + 2, 23)))
    order = lambda r: tuple((v is None, v or 0) for v in r)
    for cell in (1 << 18, 6):
        got = chain.filtered(df, makes, ["size"], "size long, place long", cell=cell).collect()
        assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert chain.filtered(df.where("false"), makes, ["size"], "size long, place long").count() == 0
    assert [f["size"] for f in chain.Chain([chain.Filter()]).take({"size": 3})] == [3]
