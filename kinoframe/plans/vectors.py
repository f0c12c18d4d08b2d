"""Queries that put known inputs and results side by side, an input a row of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoframe.sources.tables import PACKETS, packets


def literal(v) -> str:
    """A value as DuckDB SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(literal, v))}]"
    return repr(v)


def vectors(query: Callable, name: str, kind: str, pairs: list[tuple], operator: Callable[[Column], Column]) -> None:
    """A query ``name``: packet ``seq`` takes the pair of its number, ``v`` is what the operator makes of the input.

    The SQL holds the results alone, as values of type ``kind``.
    """
    n = len(pairs)
    want = f"SELECT seq, CAST(([{', '.join(literal(r) for _, r in pairs)}])[seq % {n} + 1] AS {kind}) AS v FROM ({PACKETS})"

    @query(name, want)
    def _(spark, d):
        given = F.array(*[F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.lit(x) for x, _ in pairs])
        return packets(spark, d).select("seq", F.element_at(given, (F.col("seq") % n + 1).cast("int")).alias("x")).select("seq", operator(F.col("x")).alias("v"))


def row_vectors(query: Callable, name: str, kind: str, pairs: list[tuple], operator: Callable[[DataFrame], DataFrame]) -> None:
    """The same for an operator of rows (seq, data), whose input is given in hexadecimal, that adds a column ``v``."""
    n = len(pairs)

    @query(name, f"SELECT seq, CAST(({literal([r for _, r in pairs])})[seq % {n} + 1] AS {kind}) AS v FROM ({PACKETS})")
    def _(spark, d):
        given = F.array(*[F.lit(x) for x, _ in pairs])
        return operator(packets(spark, d).select("seq", F.unhex(F.element_at(given, (F.col("seq") % n + 1).cast("int"))).alias("data"))).select("seq", "v")
