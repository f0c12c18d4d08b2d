"""Runs queries in Spark and their SQL in DuckDB over the same tables, and compares rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if (path := Path(sf_dir, f"{t}.parquet")).exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


KINDS = {"bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int", "hugeint": "int", "float": "double", "varchar": "string"}


def kind(name: str) -> str:
    name = str(name).lower()
    return KINDS.get(name, name)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the result of a query; empty if nothing does."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = dict(zip(names, con.sql(sql).types))
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    out = [f"{c}: {t} and {kinds[c]}" for c, t in df.dtypes if kind(t) != kind(kinds[c])]
    order = sorted(names)
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    mine = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    if mine != theirs:
        out.append(f"{sum(mine.values())} and {sum(theirs.values())} rows; ours alone {list((mine - theirs).items())[:3]}; theirs alone {list((theirs - mine).items())[:3]}")
    return out
