"""Whitening against NumPy over the distinct vectors, and its defined results."""

import math

import numpy as np
import pytest

from kinoframe.llm import queries, whitening
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, n int, component string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1) for i, v in rows], SCHEMA).repartition(3)


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def plain(rows):
    """What the definition says, by one dense covariance."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(whole(v)) for _, v in rows})
    n, total = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(n * x - s) / n for x, s in zip(v, total)] for v in distinct])
    covariance = centred.T @ centred / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1][:16], columns[:, ::-1][:, :16]
    out = {}
    for i, v in rows:
        d = [n * x - s for x, s in zip(whole(v), total)]
        out.setdefault(i, []).append((n, sum(y * y for y in d), np.array(d, float) / n @ columns / np.sqrt(values)))
    return out, values / np.trace(covariance)


def check(found, rows):
    want, explained = plain(rows)
    got = {}
    for r in found.collect():
        got.setdefault((r.vec_id, r.n, r.deviation), {}).setdefault(r.component, []).append(r)
    assert sorted({k[0] for k in got}) == sorted(want)
    signs = None
    for (i, n, deviation), by in got.items():
        own = [w for w in want[i] if w[:2] == (n, deviation)]
        assert own and sorted(by) == list(range(1, len(explained) + 1))
        values = np.array([by[c][0].whitened for c in sorted(by)])
        if signs is None and np.abs(own[0][2]).min() > 1e-6:
            signs = np.sign(own[0][2]) * np.sign(values)
        if signs is not None:
            assert values * signs == pytest.approx(own[0][2], abs=1e-6)
        assert [by[c][0].explained for c in sorted(by)] == pytest.approx(explained.tolist(), rel=1e-9)
        assert all(r.identity_error < 1e-8 for rs in by.values() for r in rs)


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_whitening"](spark, SF), rows)


def test_repeats_count_once_and_broken_rows_go(spark):
    pick = np.random.default_rng(5)
    base = [(i, pick.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = base + [(200 + k, base[3][1]) for k in range(30)] + odd
    found = whitening.whiten(frame(spark, rows))
    check(found, rows)
    assert found.count() == 70 * 5 and found.first().n == 40


def test_spaces_by_length_nulls_and_nothing(spark):
    pick = np.random.default_rng(6)
    rows = [(i, pick.normal(size=3).tolist()) for i in range(20)] + [(50 + i, pick.normal(size=2).tolist()) for i in range(10)] + [(90, [])]
    rows.append((None, rows[0][1]))
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.n, r.component) for r in found} == {(20, 1), (20, 2), (20, 3), (10, 1), (10, 2)}
    assert len(found) == 21 * 3 + 10 * 2 and sum(r.vec_id is None for r in found) == 3
    one = frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert whitening.whiten(one).count() == 0
    none = frame(spark, rows).where("false")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none).columns == found[0].__fields__


def test_flat_dimensions_and_huge_entries(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(8)]  # of rank one
    assert {r.component for r in whitening.whiten(frame(spark, rows)).collect()} == {1}
    huge = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and {r.deviation for r in huge} >= {None}


def test_sums_are_exact():
    block = np.array([[(1 << 60) + 1, -(1 << 60) - 3]] * 9, np.int64)
    n, sums = whitening.exact_sums(block)
    assert n == 9 and sums.tolist() == [9 * ((1 << 60) + 1), -9 * ((1 << 60) + 3)]
