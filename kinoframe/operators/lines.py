"""Lines of subtitles: pieces of text broken where they would be too wide, and evened out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A script's way of breaking lines: evened, only where it must, only where the script says, evened with a wide lower line.
SMART, GREEDY, NEVER, SMART_LOWER = range(4)


def pieces(text: Column) -> Column:
    """Words, blanks and hard breaks of a plain text, a character one wide."""
    kind = lambda x: F.when(x == r"\N", "break").when(x == " ", "space").otherwise("word")
    found = F.regexp_extract_all(text, F.lit(r"\\N| |(?:[^ \\]|\\(?!N))+"), F.lit(0))
    return F.transform(found, lambda x: F.struct(kind(x).alias("kind"), F.length(x).cast("double").alias("width")))


class Lines:
    """Breaks one event's pieces; a line is a list of the numbers of its pieces, hard breaks not counted."""

    def __init__(self, given: list[dict]):
        self.parts: list[list[int]] = [[]]
        self.width: list[float] = []
        self.blank: list[bool] = []
        for piece in given:
            if piece["kind"] == "break":
                self.parts.append([])
            else:
                self.parts[-1].append(len(self.width))
                self.width.append(piece["width"])
                self.blank.append(piece["kind"] == "space")

    def wide(self, line: list[int]) -> float:
        return sum(self.width[i] for i in line)

    def stripped(self, line: list[int]) -> list[int]:
        """A line without the blanks at its end."""
        n = len(line)
        while n and self.blank[line[n - 1]]:
            n -= 1
        return line[:n]

    def filled(self, part: list[int], most: float) -> list[list[int]]:
        """What lies between two hard breaks, each line as full as it gets; blanks go in front of a line and, save after the
        last one, at its end."""
        lines: list[list[int]] = [[]]
        wide = 0.0
        for i in part:
            if lines[-1] and not self.blank[i] and wide + self.width[i] > most:
                lines[-1] = self.stripped(lines[-1])
                lines.append([])
                wide = 0.0
            if lines[-1] or not self.blank[i]:
                lines[-1].append(i)
                wide += self.width[i]
        return lines

    def hand_down(self, lines: list[list[int]], i: int, most: float) -> bool:
        """Moves the last word of line ``i`` to the next one if that makes the wider of the two less wide."""
        upper, lower = lines[i], lines[i + 1]
        runs = [list(g) for _, g in groupby(upper, key=lambda k: self.blank[k])]
        tail = runs[-2:] if runs and self.blank[runs[-1][0]] else runs[-1:]
        word = sum(tail, [])
        rest = upper[: len(upper) - len(word)]
        below = self.wide(lower) + self.wide(word)
        if not rest or below > most or max(self.wide(rest), below) >= max(self.wide(upper), self.wide(lower)):
            return False
        lines[i], lines[i + 1] = self.stripped(rest), word + lower
        return True

    def broken(self, most: float, style: int) -> list[list[int]]:
        lines = [line for part in self.parts for line in self.filled(part, float("inf") if style == NEVER else most)]
        lines[-1] = self.stripped(lines[-1])
        if style in (SMART, SMART_LOWER):
            while any([self.hand_down(lines, i, most) for i in range(len(lines) - 1)]):
                pass
        return lines


def wrapped(events: DataFrame, most: float, style: int = SMART, column: str = "pieces") -> DataFrame:
    """Events with ``lines``, the numbers of the pieces on each line (hard breaks not counted), in place of their pieces.

    A line ends before the word that would make it wider than ``most``; hard breaks always end one, so two in a row leave an
    empty line. A word wider than ``most`` has a line of its own. Null pieces give null.
    """
    keep = [f for f in events.schema if f.name != column]
    full = StructType([*keep, *_parse_datatype_string("lines array<array<int>>")])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            made = [None if x is None else Lines(x).broken(most, style) for x in own(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[own(f.name) for f in keep], pa.array(made, arrow.field(len(keep)).type)], schema=arrow)

    return events.mapInArrow(run, full)
