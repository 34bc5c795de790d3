"""Embedding whitening by a two-pass covariance.

Vectors become integers (``floor(scale * c) + shift``), so the first pass sums them exactly, in any order. The second pass
centres each block of vectors on the exact mean and adds up its outer products by one matrix product; the partial matrices of the tasks
merge in a tree. The driver holds one symmetric matrix of dims x dims, takes its eigenvectors from LAPACK, and
broadcasts the projection. A third pass measures the covariance of the whitened vectors, each block centred before it is multiplied.
No row is shuffled: a hot vector is one row like any other, and what tasks send grows with their number and the dimensions only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, free_names

#: Sums and products below this are exact in 64-bit integers.
SAFE = 1 << 62


def usable(v: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def to_integers(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift, exactly: 64-bit integers, or Python's where they don't fit."""
    scaled = np.floor(scale * v)
    if not len(v) or np.abs(scaled).max(initial=0) < 1 << 52:
        return scaled.astype(np.int64) + shift
    limit = np.finfo(float).max
    return np.array([[int(min(max(c, -limit), limit)) + shift for c in row] for row in scaled], object)


def _column_sums(x: np.ndarray) -> list[int]:
    if x.dtype == object or len(x) * int(np.abs(x).max(initial=0)) >= SAFE:
        return [int(s) for s in x.astype(object).sum(0)]
    return x.sum(0).tolist()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """n * x - S as exact integers, and their squares summed by row."""
    most = max([int(np.abs(x).max(initial=0)) if x.size else 0, *(abs(s) // n for s in sums)], default=0) + 1
    if x.dtype != object and 2 * n * most < SAFE:
        y = x * n - np.array(sums, np.int64)
        peak = int(np.abs(y).max(initial=0))
        if peak * peak * max(1, x.shape[1]) < SAFE:
            return (y * y).sum(1).tolist()
        y = y.astype(object)
    else:
        y = x.astype(object) * n - np.array(sums, object)
    return [int(s) for s in (y * y).sum(1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, from the exact n * x - S."""
    most = max([int(np.abs(x).max(initial=0)) if x.size else 0, *(abs(s) // n for s in sums)], default=0) + 1
    if x.dtype != object and 2 * n * most < SAFE:
        return (x * n - np.array(sums, np.int64)) / n
    return np.array([[float((int(c) * n - s) / n) for c, s in zip(row, sums, strict=True)] for row in x], float).reshape(x.shape)


def _tree(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], object], merge: Callable, depth: int):
    """One value of a whole column of vectors: ``part`` of each task's blocks, merged in a tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(_matrix(b.column(0)) for b in batches if len(b))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    def loads(_, row):
        return merge(_, pickle.loads(row["part"]))

    return rows.mapInArrow(run, "part binary").rdd.treeAggregate(None, loads, merge, depth)


class Whitening:
    """What the fit found: n, dims, sums, covariance, eigenvalues and unit eigenvectors by falling eigenvalue, identity error."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int, scale: float, shift: int) -> None:
        self.n, self.sums, self.covariance, self.scale, self.shift = n, sums, covariance, scale, shift
        values, vectors = np.linalg.eigh(covariance) if len(covariance) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        trace = float(np.trace(covariance))
        # an eigenvalue within rounding of zero has no direction to stretch
        self.flat = self.values <= trace * 1e-13
        self.explained = self.values / trace if trace > 0 else np.zeros(len(self.values))
        self.projection = self.vectors / np.sqrt(np.where(self.flat, 1.0, self.values))
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.projection


def _cleaned(rows: DataFrame, v_col: str) -> tuple[DataFrame, int]:
    """Usable rows, and their number of dimensions: the most frequent length, the larger one of equally frequent ones."""
    rows = rows.where(usable(F.col(v_col)))
    size = F.size(v_col)
    lengths = rows.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    dims = lengths["d"] if lengths else 0
    return rows.where(size == dims), dims


def fit(rows: DataFrame, v_col: str = "embedding", components: int = 8, scale: float = 1024, shift: int = 100_000, depth: int = 2) -> Whitening | None:
    """Fit on all usable vectors of ``rows``; None if there are none.

    Memory: one dims x dims matrix of doubles in each task and on the driver, merged in a tree of ``depth``.
    """
    rows, dims = _cleaned(rows.select(v_col), v_col)
    if not dims:
        return None
    bounded_batches(rows.sparkSession)

    def add(a, b):
        if a is None or b is None:
            return a if b is None else b
        return tuple([p + q for p, q in zip(x, y, strict=True)] if isinstance(x, list) else x + y for x, y in zip(a, b, strict=True))

    def sums_of(blocks: Iterator[np.ndarray]):
        found = None
        for v in blocks:
            found = add(found, (len(v), _column_sums(to_integers(v, scale, shift))))
        return found

    n, sums = _tree(rows, sums_of, add, depth)

    def products_of(blocks: Iterator[np.ndarray]):
        found = None
        for v in blocks:
            c = centred(to_integers(v, scale, shift), n, sums)
            found = add(found, (c.T @ c,))
        return found

    (products,) = _tree(rows, products_of, add, depth)
    found = Whitening(n, sums, products / n, components, scale, shift)

    def moments_of(blocks: Iterator[np.ndarray]):
        total = None
        for v in blocks:
            w = found.project(to_integers(v, scale, shift))
            mean = w.mean(0)
            total = pooled(total, (len(w), mean, (w - mean).T @ (w - mean)))
        return total

    _, _, moments = _tree(rows, moments_of, pooled, depth)
    kept = ~found.flat
    found.identity_error = float(np.abs(moments[np.ix_(kept, kept)] / n - np.eye(int(kept.sum()))).max(initial=0))
    return found


def pooled(a, b):
    """Merge (count, mean, centred products) of two sets of vectors."""
    if a is None or b is None:
        return a if b is None else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, id_col: str = "vec_id", v_col: str = "embedding", components: int = 8, scale: float = 1024, shift: int = 100_000, model: Whitening | None = None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each usable vector and component.

    Vectors that are null, empty or hold null or non-finite entries are dropped, as are those of another length than most have. Repeated rows and rows
    without an identifier count and are returned like others; ties of eigenvalues share any basis of their space, the same for all rows. ``deviation`` is decimal(38), exact
    at any n, and null from 10 ** 38 on. A component without variance (all vectors equal, or fewer vectors than components) has ``whitened`` null, ``explained`` 0 and no part in the
    identity error. An empty table gives no rows. Other columns aren't read.
    """
    name = free_names(rows, 2)
    vectors = rows.select(F.col(id_col).alias(name[0]), F.col(v_col).alias(name[1]))
    ids = vectors.schema[name[0]].dataType.simpleString()
    schema = f"`{id_col}` {ids}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = model or fit(vectors, name[1], components, scale, shift)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    vectors = vectors.where(usable(F.col(name[1])) & (F.size(name[1]) == len(found.sums)))
    bounded_batches(rows.sparkSession)
    shipped = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        k = len(w.values)
        for batch in batches:
            if not len(batch):
                continue
            x = to_integers(_matrix(batch.column(1)), w.scale, w.shift)
            rows_of = np.repeat(np.arange(len(x)), k)
            spread = pa.array([d if d < 10**38 else None for d in deviations(x, w.n, w.sums)], pa.decimal128(38, 0))
            values = pa.array(w.project(x).ravel(), mask=np.tile(w.flat, len(x)))
            columns = [batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n, np.int64)), spread.take(pa.array(rows_of)), values, pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(x) * k, w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
