"""Folds over groups in order, in as many tasks as a group has cells.

A group of few rows is folded as it is, in one task. The rows of a longer one are cut into *cells* by their sequence numbers, by
counts, so that a cell is neither long nor short whatever numbers a group has. A fold of a cell needs the state that the cells before it
leave. Two ways lead there, and both are settled before a row is put out:

* **Composed.** Where a row is a small function of the state, a cell is the composition of its rows' functions (``carry``), which
  is made without knowing the state. Cells are then carried on one after another, a row a cell.
* **Speculated.** Else a cell is folded from the state of a beginning. Folds forget, so that is what it leaves in most cases
  whatever came before. Cells are walked in order with the states that they leave; one that was folded from another state
  than it is entered with is folded again from that. The first such cell of a group is entered rightly, so rounds come to
  an end; as a rule after one or two. What is left of a group after ``ROUNDS`` of them is folded on from there, one cell after the
  other, so that a fold that does not forget takes one pass more, not one a cell.

A composed function may say that it does not know a state (``None``); such a cell is folded from it as well.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from operator import and_
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from kinoframe.scratch import cut

#: Rows that a cell has, up to twice as many; rounds of cells folded again; places of cells that are sent to all tasks.
CELL, ROUNDS, SENT = 1 << 18, 2, 1 << 16


class Carry(Protocol):
    """What the rows of a cell do to a state."""

    def then(self, *inputs: Any) -> None:
        """One more row."""

    def after(self, state: Any) -> Any | None:
        """The state after all rows; None if that is not known for this one."""


class Rising:
    """x becomes max(low, x + shift + the number of ``places`` above x): what a row of functions comes to that raise a number to
    a bound, or by one if it lies below another."""

    def __init__(self, low: int):
        self.low, self.shift, self.places = low, 0, []

    def reach(self, value: int) -> int:
        """The least x that comes to ``value`` or more, the bound aside."""
        places, n = self.places, len(self.places)
        a, b = 0, n
        while a < b:
            mid = (a + b) // 2
            if places[mid] - 1 + self.shift + n - mid >= value:
                b = mid
            else:
                a = mid + 1
        least = value - self.shift - (n - a)
        return max(places[a - 1], least) if a else least

    def one_more_below(self, value: int) -> None:
        """What comes to less than ``value`` comes to one more."""
        insort(self.places, self.reach(value))

    def pruned(self) -> None:
        """Forgets places of numbers that come out at the bound."""
        if self.places:
            del self.places[: bisect_right(self.places, self.reach(self.low))]

    def of(self, x: int) -> int:
        return max(self.low, x + self.shift + len(self.places) - bisect_right(self.places, x))


def columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys, nulls included."""
    both = F.lit(True)
    for k in keys:
        both = both & left[k].eqNullSafe(right[k])
    return both


def celled(rows: DataFrame, by: list[str], seq: str, cell: int, like: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with their ``_cell`` and the last cell of their group, ``_final``; whether any group has more than one.

    A group of more than ``cell`` rows is counted in spans of as many sequence numbers, which are put together until they have
    that many rows.
    """
    spanned = lambda part: part.withColumn("_span", F.call_function("div", F.col(seq).cast("long"), F.lit(cell)))
    renamed = lambda part, keys: part.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(keys)})
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
        return reduce(and_, [left[c].eqNullSafe(right[f"_of_{i}"]) for i, c in enumerate(keys)], F.lit(True))

    counted = F.count(F.lit(1)).alias("_n")
    groups = cut(renamed(like.groupBy(*by).agg(counted).where(F.col("_n") > cell), by))
    if groups.isEmpty():
        return rows.withColumns({"_cell": F.lit(0).cast("long"), "_final": F.lit(0).cast("long")}), False
    w = Window.partitionBy(*by).orderBy("_span")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spanned(like.join(groups, met(like, groups, by), "left_semi")).groupBy(*by, "_span").agg(counted)
    spans = spans.withColumn("_cell", F.call_function("div", before, F.lit(cell))).withColumn("_final", F.max("_cell").over(Window.partitionBy(*by)))
    spans = cut(renamed(spans.drop("_n"), [*by, "_span"]))
    rows = spanned(rows)
    found = rows.join(F.broadcast(spans) if spans.count() <= SENT else spans.hint("merge"), met(rows, spans, [*by, "_span"]), "left")
    return found.select(*[c for c in rows.columns if c != "_span"], zero("_cell"), zero("_final")), True


def scanned(
    rows: DataFrame,
    by: list[str],
    inputs: list[str],
    start: Callable[[], Any],
    step: Callable[..., tuple],
    schema: str,
    *,
    seq: str = "seq",
    cell: int = CELL,
    carry: Callable[[], Carry] | None = None,
    moved: Callable[[Any, Any, Any], Any | None] | None = None,
    finish: Callable[[Any], list[tuple]] | None = None,
    like: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with the columns of ``schema``, which ``step(state, *inputs)`` gives for each row of a group in order of ``seq``.

    ``start`` makes a group's state, which ``step`` changes; states are pickled and compared. Where equal states may differ in
    what a fold only hands on (an offset, say), ``moved(entry, left, state)`` is what a cell that leaves ``left`` from ``entry``
    leaves from ``state``, or None. ``finish`` gives rows that are put out after the last one of a group, as values of
    ``schema``; their other columns but the group's are null. ``like`` has the groups and numbers of ``rows`` where those are dear
    to make.
    """
    extra = _parse_datatype_string(schema)
    keys = [*by, "_cell"]
    key_fields = [*[rows.schema[c] for c in by], *_parse_datatype_string("_cell long")]
    known_schema = StructType([*key_fields, *_parse_datatype_string("_final long, _round int, _entry binary, _exit binary, _carry binary")])
    walk_schema = StructType([*key_fields, *_parse_datatype_string("_entry binary, _settled boolean, _last boolean")])
    known_arrow, walk_arrow = to_arrow_schema(known_schema), to_arrow_schema(walk_schema)
    k, first = len(by), pickle.dumps(start())
    placed, cells = celled(rows, by, seq, cell, rows if like is None else like)
    nothing = lambda part: part.withColumn("_entry", F.lit(None).cast("binary"))

    def headed(part: DataFrame, entries: DataFrame, dealt: list[str] = keys) -> DataFrame:
        """Cells in order, each behind a row with the state it is entered with."""
        heads = entries.select(*keys, "_entry", "_last")
        both = nothing(part).withColumn("_last", F.lit(None).cast("boolean")).unionByName(heads, allowMissingColumns=True)
        return both.repartition(*dealt).sortWithinPartitions(*keys, F.col("_entry").isNull(), seq)

    def summed(part: DataFrame, number: int, onward: bool = False) -> DataFrame:
        """What cells leave. ``onward``: a cell without a head is entered with what the one before it leaves."""
        composed = carry is not None and number == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, end, entry, state, function, done = None, None, None, None, None, []

            def closed() -> tuple:
                return (*key, end, number, entry, None if composed else pickle.dumps(state), pickle.dumps(function) if composed else None)

            for batch in batches:
                for row in columns(batch, [*keys, "_entry", "_final", *inputs]):
                    if row[: k + 1] != key:
                        follows = onward and key is not None and row[:k] == key[:k]
                        if key is not None:
                            done.append(closed())
                        key, entry = row[: k + 1], row[k + 1] or (pickle.dumps(state) if follows else first)
                        state, function = (None, carry()) if composed else (pickle.loads(entry), None)
                    if row[k + 1] is not None:
                        continue
                    end = row[k + 2]
                    if composed:
                        function.then(*row[k + 3 :])
                    else:
                        step(state, *row[k + 3 :])
                if done:
                    yield as_batch(done, known_arrow)
                    done = []
            if key is not None:
                yield as_batch([closed()], known_arrow)

        return part.mapInArrow(run, known_schema)

    def walked(known: DataFrame) -> DataFrame:
        """The state that each cell is entered with, by what is known of the cells before it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in columns(batch, known_schema.names))
            for group, cells in groupby(rows, key=lambda r: r[:k]):
                state, made = start(), []
                for key, tries in groupby(cells, key=lambda r: r[: k + 1]):
                    after, guess = None, state
                    for *_, end, _, entry, left, function in tries:
                        if function is not None:
                            after = after if after is not None else pickle.loads(function).after(state)
                        else:
                            before, guess = pickle.loads(entry), pickle.loads(left)
                            if moved and (told := moved(before, guess, state)) is not None:
                                guess = told
                            elif moved:
                                before = None
                            after = guess if after is None and before == state else after
                    made.append((*key, pickle.dumps(state), after is not None, False))
                    state = guess if after is None else after
                yield as_batch([*made, (*group, end, pickle.dumps(state), True, True)], walk_arrow)

        return known.repartition(*by).sortWithinPartitions(*keys, "_round").mapInArrow(run, walk_schema)

    def settled() -> DataFrame:
        """The state that each cell of the groups with more than one is entered with."""
        inner = placed.where(F.col("_cell") < F.col("_final"))  # what a last cell leaves is not asked for
        known = cut(summed(nothing(inner).repartition(*keys).sortWithinPartitions(*keys, seq), 0))
        number = 0
        while True:
            entries = cut(walked(known))
            missed = entries.where(~F.col("_settled"))
            if missed.isEmpty():
                return entries
            number += 1
            if number <= ROUNDS:
                part = headed(inner.join(missed, same(inner, missed, keys), "left_semi"), missed)
            else:
                heads = missed.groupBy(*by).agg(F.min_by(F.struct("_cell", "_entry", "_last"), "_cell").alias("_head")).select(*by, "_head.*")
                part = headed(inner.join(heads, same(inner, heads, by) & (inner["_cell"] >= heads["_cell"]), "left_semi"), heads, by)
            known = cut(known.unionByName(summed(part, number, number > ROUNDS)))

    own = [StructField(f.name, f.dataType, f.nullable or bool(finish)) for f in rows.schema]
    full = StructType([*own, *extra])
    arrow, names = to_arrow_schema(full), rows.columns
    placing = [names.index(c) for c in by]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, last = None, None, False

        def ended() -> list[tuple]:
            more = finish(state) if finish and last else []
            group = [None] * len(names)
            for i, v in zip(placing, key or ()):
                group[i] = v
            return [(*group, *m) for m in more]

        for batch in batches:
            made, keep, ends = [], [], []
            for i, row in enumerate(columns(batch, [*keys, "_entry", "_last", *inputs])):
                if row[k + 1] is not None or row[: k + 1] != key:
                    ends += ended()
                    # a cell without a head is a whole group
                    state, key, last = pickle.loads(row[k + 1] or first), row[: k + 1], row[k + 1] is None or row[k + 2]
                if row[k + 1] is None:
                    keep.append(i)
                    made.append(step(state, *row[k + 3 :]))
            if keep:
                yield taken(batch, keep, made)
            if ends:
                yield as_batch(ends, arrow)
        if ends := ended():
            yield as_batch(ends, arrow)

    def taken(batch: pa.RecordBatch, keep: list[int], made: list[tuple]) -> pa.RecordBatch:
        part = batch.take(pa.array(keep)) if len(keep) < batch.num_rows else batch
        old = [part.column(part.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*old, *[pa.array([m[i] for m in made], arrow.field(len(names) + i).type) for i in range(len(extra))]], schema=arrow)

    if cells:
        dealt = headed(placed, settled())
    else:
        dealt = nothing(placed).withColumn("_last", F.lit(None).cast("boolean")).repartition(*by).sortWithinPartitions(*by, seq)
    return dealt.mapInArrow(out, full)
