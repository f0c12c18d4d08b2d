"""Cells by their rows, and rounds of folds that do not forget."""

import random
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from kinoframe.operators import gop, scans
from kinoframe.plans import registry
from tests.compare import differences, duck
from tests.conftest import SF


@dataclass
class Total:
    sum: int = 0


def add(state, x):
    state.sum += x
    return (state.sum,)


@pytest.fixture
def cuts(monkeypatch):
    """Counts what is written between."""
    made = []
    monkeypatch.setattr(scans, "cut", lambda df, own=scans.cut: made.append(1) or own(df))
    return made


def totals(spark, rows, cell, **more):
    df = spark.createDataFrame(rows, "g long, seq long, x long")
    return {(r.g, r.seq): r.total for r in scans.scanned(df, ["g"], ["x"], Total, add, "total long", cell=cell, **more).collect()}


def loop(rows):
    sums, want = {}, {}
    for g, seq, x in rows:
        sums[g] = want[g, seq] = sums.get(g, 0) + x
    return want


def test_short_groups_are_one_cell_however_far_their_numbers_lie_apart(spark, cuts):
    rows = [(i % 5, i * 1_000 + 7, i) for i in range(50)]
    assert totals(spark, rows, 10) == loop(rows) and len(cuts) == 1


def test_cells_have_rows_by_count_and_null_groups_are_groups(spark):
    rows = [(1, i * 300, 1) for i in range(40)] + [(2, i, 1) for i in range(90)] + [(None, i * 50, 1) for i in range(30)] + [(3, 5, 1)]
    df = spark.createDataFrame(rows, "g long, seq long, x long")
    placed, many = scans.celled(df, ["g"], "seq", 10, df)
    sizes = {}
    for r in placed.groupBy("g", "_cell", "_final").count().collect():
        sizes.setdefault(r.g, []).append((r["_cell"], r["count"]))
        assert r["_cell"] <= r["_final"]
    assert many and {g: len(s) for g, s in sizes.items()} == {1: 4, 2: 9, None: 3, 3: 1}
    assert all(n <= 20 for s in sizes.values() for _, n in s)


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_a_fold_that_does_not_forget_takes_few_rounds(spark, cuts, monkeypatch, sent):
    monkeypatch.setattr(scans, "SENT", sent)
    pick = random.Random(2)
    rows = [(g, i * (g + 1), pick.randrange(9) + 1) for g in range(3) for i in range(13 * (g + 1))]
    assert totals(spark, rows, 3) == loop(rows) and len(cuts) <= 4 + 2 * (scans.ROUNDS + 1)


def test_ends_of_groups_come_once(spark):
    rows = [(g, i * 10, 1) for g in range(4) for i in range(g * 6 + 1)]
    df = spark.createDataFrame(rows, "g long, seq long, x long")
    got = scans.scanned(df, ["g"], ["x"], Total, add, "total long", cell=5, finish=lambda s: [(s.sum,)]).where("seq is null").collect()
    assert sorted((r.g, r.total) for r in got) == [(g, g * 6 + 1) for g in range(4)]


def test_group_numbers_of_a_cache_take_no_rounds(spark, cuts):
    rows = [(1, i, i % 4 == 0, 1) for i in range(96)]
    df = spark.createDataFrame(rows, "stream_index long, seq long, is_key boolean, size long")
    got = {(r.seq, r.group) for r in gop.cached(df, 2, 10, 100, cell=8).collect()}
    assert got == {(i, i // 4) for i in range(84, 96)} and len(cuts) <= 6


def test_copied_sound_of_a_long_stream(spark, tmp_path):
    """The thousandth of a second of the 2098th packet is past an int before it is divided."""
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.lit(0).cast("long")).crossJoin(spark.range(3)).withColumn("event_id", F.col("id") * 1_000 + F.col("event_id")).drop("id").write.parquet(f"{tmp_path}/parts")
    con = duck(SF)
    con.execute(f"COPY (SELECT * FROM read_parquet('{tmp_path}/parts/*.parquet')) TO '{tmp_path}/events.parquet'")
    assert con.execute(f"SELECT count(*), count(DISTINCT event_id) FROM '{tmp_path}/events.parquet'").fetchone() == (3_000, 3_000)
    assert differences(registry.QUERIES["mux_sound"](spark, str(tmp_path)), duck(tmp_path), registry.ORACLE["mux_sound"]) == []
