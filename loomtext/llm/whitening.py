"""Operator 12: whitening of embeddings by their principal components, which cyclic Jacobi rotations find.

Vectors are put on a grid of whole numbers, x = floor(GRID c) + SHIFT, so that sums, deviations and which vectors are equal
are exact. Equal vectors are met before anything is fitted: the fit list has each once. Two passes over it give the sums S
and the scatter of (n x - S) / n, where n x - S is a whole number, so centring costs no digit. The driver has one matrix
of d x d and turns it by Jacobi rotations, sweep by sweep, until each entry off the diagonal is below rounding beside the
two entries on the diagonal it belongs to; measured so, small eigenvalues keep their digits. The whitening matrix goes to
all tasks. A last pass over the fit list measures how far the whitened covariance is from the identity.

What is shuffled is the fit list, once, and d (d + 1) / 2 sums from each task.

Defined results: rows whose vector is null, or holds an entry that is null, NaN or infinite, are left out, as are vectors
that haven't the length that most fitted vectors have (the longer one of equally many); a null vec_id stays null; repeated
rows are told as often as they come, and count once in the fit; components beyond the vectors' dimension don't exist; a
component without variance (beyond double precision) has the whitened value null and isn't part of the identity error; an
empty table gives no rows. An entry so large that n times it isn't a whole number of 63 bits is an error, a deviation
beyond 63 bits is null. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomtext.llm.scratch import materialise

GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: An entry off the diagonal counts as none from here on, beside the geometric mean of its diagonal entries.
ROUNDING = 2.0**-53
_MOST = 2**62


def on_grid(vector: Column) -> Column:
    """array<long>: each entry, as double, on the grid; null for vectors that are left out."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is above infinity
    entry = lambda c: F.floor(F.lit(GRID) * c.cast("double")) + F.lit(SHIFT)
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, entry))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an array<long> column, all of length d."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], cells: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The products of the columns of of(x), summed over all vectors x; `cells` are the upper cells of that matrix."""
    n = len(cells[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            y = of(_matrix(batch.column("x"), d))
            total += (y.T @ y)[cells]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["cell", "s"])

    sums = fit.select("x").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s"))
    out = np.zeros(n)
    for r in sums.collect():  # as many rows as a d x d matrix has upper cells
        out[r["cell"]] = r["s"]
    k = int(cells[0].max()) + 1
    full = np.zeros((k, k))
    full[cells] = out
    return full + np.triu(full, 1).T


def jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic rotations."""
    a, turned, d = v.astype(float).copy(), np.eye(len(v)), len(v)
    rotated = True
    while rotated:
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= ROUNDING * np.sqrt(abs(a[p, p]) * abs(a[q, q])) or abs(off) < np.finfo(float).tiny:
                    continue
                rotated = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                pair, diagonal = [p, q], (a[p, p] - t * off, a[q, q] + t * off)
                a[:, pair] = a[:, pair] @ turn
                a[pair, :] = a[:, pair].T
                a[p, p], a[q, q] = diagonal
                a[p, q] = a[q, p] = 0.0
                turned[:, pair] = turned[:, pair] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


class Whitening:
    """What a fit gives: n, sums (whole numbers), eigenvalues and vectors, the projection, and how exact it is."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int) -> None:
        self.n, self.sums, self.dimension = n, sums, len(sums)
        values, vectors = jacobi(covariance)
        k = min(components, self.dimension)
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = values[:k], vectors[:, :k]
        self.real = self.values > self.dimension * np.finfo(float).eps * max(float(values[0]), 0.0)
        self.explained = np.where(self.real, self.values / self.trace if self.trace > 0 else 0.0, 0.0)
        self.projection = np.where(self.real, self.vectors / np.sqrt(np.where(self.real, self.values, 1.0)), 0.0)
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in whole numbers."""
        if x.size and int(np.abs(x).max()) * self.n >= _MOST:
            raise ValueError("an entry is too large for exact sums")
        return x * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.projection


def _fit_list(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """The distinct vectors x of the commonest length, that length and their number."""
    distinct = materialise(vectors.select("x").distinct(), "distinct")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return (distinct, 0, 0) if most is None else (distinct.where(F.size("x") == most["d"]), most["d"], most["n"])


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of `vectors` (x, array<long>); None if there are none."""
    fit, d, n = _fit_list(vectors)
    if not n:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if x.size and int(np.abs(x).max()) * n >= _MOST:
                raise ValueError("an entry is too large for exact sums")
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array(total, pa.int64())], names=["at", "s"])

    sums = fit.mapInArrow(run, "at long, s long").groupBy("at").agg(F.sum("s").alias("s"))
    exact = np.array([r["s"] for r in sums.orderBy("at").collect()], np.int64)  # d rows
    whole = lambda x: (x * n - exact) / n  # noqa: E731  as Whitening.centred, which fit_whitening's pass over entries has cleared
    covariance = _summed(fit, d, whole, np.triu_indices(d)) / n
    found = Whitening(n, exact, covariance, components)
    if found.real.any():
        k = int(found.real.sum())
        white = _summed(fit, d, lambda x: found.whitened(x)[:, :k], np.triu_indices(k)) / n
        found.identity_error = float(np.abs(white - np.eye(k)).max())
    return found


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of `rows` (vec_id, embedding) that
    isn't left out and each of its first components, numbered from 1 by falling eigenvalue."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select(rows["vec_id"].cast("long").alias("vec_id"), on_grid(rows["embedding"]).alias("x")).where("x is not null")
    found = fit_whitening(vectors, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    k, d = len(found.values), found.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            many = len(x)
            y = found.centred(x)
            if int(np.abs(y).max(initial=0)) ** 2 * d < _MOST:
                deviation = (y * y).sum(axis=1).tolist()
            else:
                deviation = [s if s < 2**63 else None for s in (sum(e * e for e in row) for row in y.tolist())]
            white = found.whitened(x).reshape(-1)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(many), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)),
                pa.array(np.full(many * k, found.n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                pa.array(white, mask=np.tile(~found.real, many)),
                pa.array(np.tile(found.explained, many)),
                pa.array([found.identity_error] * (many * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.where(F.size("x") == d).mapInArrow(run, schema)
