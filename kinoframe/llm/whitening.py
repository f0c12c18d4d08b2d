"""Whitening of embeddings: principal components of unit variance, from a covariance in two passes.

The fit list is each distinct vector once, so copies weigh no more than what they copy. Entries are counted in steps of
1/64 as whole numbers. A first pass sums them exactly, which gives the mean; a second one sums the outer products of centred
vectors by matrix products of blocks. Both leave one partial result a partition, which ``treeAggregate`` merges. LAPACK's
symmetric solver gives the components, which are broadcast (16 times the dimension) and applied to every row.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; repeated rows give repeated
results and count once in the fit; null ids are kept; vectors of each length are a space of their own, fitted and whitened
by itself, and empty vectors have no component; an empty table gives no rows; other columns are ignored. Components without
variance, up to rounding, cannot be scaled and are left out, so that a single distinct vector gives no rows. Of equal
eigenvalues any orthogonal components may be returned. Entries beyond 2^55 count as 2^55, and a ``deviation`` that no long
holds is null.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kinoframe.llm.base import stored

STEPS, SHIFT = 64, 1_000_000
#: Rows of a block: what one matrix product takes.
BLOCK = 4096
#: Lengths of vectors that a table may hold; each is a fit of its own.
MOST_LENGTHS = 64
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def counted(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the whole-number vector, of the rows whose vector is whole."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    most = float(STEPS << 55)
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * STEPS, F.lit(-most)), F.lit(most))) + F.lit(SHIFT).cast("long"))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", x.alias("x"))


def blocks(x: pa.Array, size: int) -> Iterator[np.ndarray]:
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for a in range(0, len(flat), BLOCK):
        yield flat[a : a + BLOCK]


def tree_sum(rows: DataFrame, size: int, of: Callable[[np.ndarray], tuple], depth: int) -> tuple | None:
    """The sum, part by part, of what ``of`` gives for each block of vectors; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for block in blocks(batch.column(0), size):
                own = added(own, of(block))
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["part"])

    parts = rows.mapInArrow(partial, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeAggregate(None, added, added, depth)


def added(a: tuple | None, b: tuple | None) -> tuple | None:
    return a if b is None else b if a is None else tuple(x + y for x, y in zip(a, b))


def exact_sums(block: np.ndarray) -> tuple:
    """Rows, and the sums of each dimension as Python numbers: the halves of 32 bits of a block cannot overflow."""
    low, high = (block & 0xFFFFFFFF).sum(0), (block >> 32).sum(0)
    return len(block), np.array([(int(h) << 32) + int(w) for h, w in zip(high, low)], object)


@dataclass
class Model:
    """A fit: ``n`` vectors with sums n * base + rest, and components as columns scaled to unit variance."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, block: np.ndarray) -> np.ndarray:
        """Vectors less the mean: whole numbers first, so that nothing is lost."""
        return (block - self.base).astype(float) - (self.rest / self.n).astype(float)

    def whitened(self, block: np.ndarray) -> np.ndarray:
        return self.centred(block) @ self.scaled

    def deviations(self, block: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        z = block - self.base
        most = self.n * int(np.abs(z).max(initial=0)) + int(max(abs(r) for r in self.rest))
        whole = block.shape[1] * most * most < 1 << 63
        d = self.n * (z if whole else z.astype(object)) - self.rest.astype(np.int64 if whole else object)
        return [x if (x := int(v)) < 1 << 63 else None for v in (d * d).sum(1)]


def fit(vectors: DataFrame, size: int, components: int = 16, depth: int = 2) -> Model | None:
    """The model of a table of distinct vectors ``x`` of one size; None without rows."""
    sums = tree_sum(vectors, size, exact_sums, depth)
    if sums is None:
        return None
    n, total = sums
    base = np.array([(2 * int(s) + n) // (2 * n) for s in total], np.int64)
    rest = np.array([int(s) - n * int(b) for s, b in zip(total, base)], object)
    model = Model(n, base, rest, np.zeros((size, 0)), np.zeros(0))
    context = vectors.sparkSession.sparkContext
    first = context.broadcast(model)

    def outer(block: np.ndarray) -> tuple:
        c = first.value.centred(block)
        return (c.T @ c,)

    covariance = tree_sum(vectors, size, outer, depth)[0] / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    keep = [i for i in range(min(components, size)) if values[i] > values[0] * size * np.finfo(float).eps]
    model.scaled = columns[:, keep] / np.sqrt(values[keep])
    model.explained = values[keep] / np.trace(covariance)
    if keep:
        second = context.broadcast(model)

        def white(block: np.ndarray) -> tuple:
            w = second.value.whitened(block)
            return (w.T @ w,)

        model.identity_error = float(np.abs(tree_sum(vectors, size, white, depth)[0] / n - np.eye(len(keep))).max())
    return model


def applied(rows: DataFrame, size: int, model: Model) -> DataFrame:
    """A row for each row of (vec_id, x) and component."""
    shared, schema = rows.sparkSession.sparkContext.broadcast(model), _parse_datatype_string(RESULT)
    arrow, k = to_arrow_schema(schema), len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1), size):
                rows = len(block)
                each = np.repeat(np.arange(rows), k)
                columns = [
                    batch.column(0).slice(at, rows).take(pa.array(each)),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    np.full(rows * k, m.n),
                    pa.array(m.deviations(block), pa.int64()).take(pa.array(each)),
                    m.whitened(block).ravel(),
                    np.tile(m.explained, rows),
                    np.full(rows * k, m.identity_error),
                ]
                at += rows
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=arrow)

    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """All rows in whitened components, by the fit of the table's distinct vectors."""
    rows = counted(vectors, id_col, vector_col)
    distinct = stored(rows.select("x").distinct(), "whitening")
    sizes = sorted(r[0] for r in distinct.select(F.size("x")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of over {MOST_LENGTHS} lengths: not a table of embeddings")
    out = [vectors.sparkSession.createDataFrame([], RESULT)]
    for size in filter(None, sizes):
        same = F.size("x") == size
        model = fit(distinct.where(same), size, components)
        if model is not None and len(model.explained):
            out.append(applied(rows.where(same), size, model))
    return reduce(DataFrame.unionByName, out[1:]) if len(out) > 1 else out[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all embeddings in their first 16 components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
