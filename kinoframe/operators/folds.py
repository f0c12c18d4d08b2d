"""Folds over a group in order, for what has no closed form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def folded(rows: DataFrame, by: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[..., tuple], schema: str) -> DataFrame:
    """``rows`` with the columns of ``schema``, which ``step(state, *inputs)`` gives for each row of a group in order.

    ``start`` makes a group's state. Rows come sorted, an Arrow batch at a time, and only the state is carried from one
    batch to the next: memory does not grow with a group. A group's rows are one task.
    """
    extra = _parse_datatype_string(schema)
    full = StructType([*rows.schema, *extra])
    arrow, n = to_arrow_schema(full), len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = object(), None
        for batch in batches:
            made = []
            values = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*by, *inputs])
            for row in zip(*values):
                if row[: len(by)] != group:
                    group, state = row[: len(by)], start()
                made.append(step(state, *row[len(by) :]))
            new = [pa.array([m[i] for m in made], arrow.field(n + i).type) for i in range(len(extra))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, full)
