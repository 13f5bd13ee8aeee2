"""Whitening of embeddings: the leading eigenvectors of their covariance by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an entry is multiplied by before it is rounded down, and what is added then.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more have no long x, and count as not finite.
LARGEST = 2.0**52
#: Components sought beyond the wanted ones; vectors kept on the driver; passes.
EXTRA, MOST_BASIS, MOST_PASSES = 8, 512, 400
#: Residuals of certified components, and eigenvalues that count as zero, as parts of the largest eigenvalue.
CERTAIN, ZERO = 1e-13, 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors of x with sums S; components (columns), their eigenvalues, the covariance's trace, and how far whitened rows are from white."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and vector of the rows whose vector isn't null and holds only finite entries, as doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return rows.where(F.col("vector").isNotNull() & ~bad)


def _x(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _spread(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python's integers where these could overflow."""
    if x.size and int(np.abs(x).max()) * n >= 1 << 61:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _squares(spread: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null beyond a long."""
    if spread.size and int(np.abs(spread).max()) ** 2 * spread.shape[1] >= 1 << 63:
        return [int(s) if s < 1 << 63 else None for s in (spread.astype(object) ** 2).sum(axis=1)]
    return (spread * spread).sum(axis=1).tolist()


def _totals(rows: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _x(batch, dim)
            n, total = n + len(x), total + x.sum(axis=0, dtype=object if x.size and int(np.abs(x).max()) * len(x) >= 1 << 62 else np.int64)
        if n:
            sums = pa.array([int(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), sums], ["i", "n", "s"])

    each = rows.select("vector").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (each[0].n if each else 0), tuple(int(r.s) for r in each)


def _summed(rows: DataFrame, dim: int, size: int, of) -> np.ndarray:
    """The sum over all rows of of(x), an array of `size` numbers for a batch: each task gives one row a number, and Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_x(batch, dim))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["i", "s"])

    each = rows.select("vector").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in each:
        out[r.i] = r.s
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """What block adds to the orthonormal basis, as orthonormal columns; none for what is rounding."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, sizes > 1e-14 * scale]
    left = left - basis @ (basis.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def fit(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> Whitening | None:
    """The leading k eigenpairs of the covariance of x = floor(1024 * c) + 100000, over all usable rows; None if there are no such rows.

    The covariance itself is never made. A pass of Spark gives Xᵀ(XQ) for a block Q of k + 8 orthonormal columns, with rows X centred exactly. The
    products extend the space from which the Rayleigh-Ritz method takes components, and what they leave over, made orthonormal, is the next
    block, until the residuals of all k are within 1e-13 of the largest eigenvalue, or the space is whole: that takes at most dim / (k + 8)
    passes. A space of over 512 columns starts again from its leading 2 (k + 8). Only such blocks, of dim numbers a column, reach the driver.
    A last pass measures the whitened rows' covariance.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes or not sizes[0].dim:
        return None
    dim = sizes[0].dim
    rows = rows.where(F.size("vector") == dim)
    n, sums = _totals(rows, dim)
    centred = lambda x: _spread(x, n, sums).astype(float) / n

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

        out = _summed(rows, dim, q.size + 1, of) / n
        return out[:-1].reshape(q.shape), out[-1]

    width = min(k + EXTRA, dim)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    basis, products, trace, passes = np.zeros((dim, 0)), np.zeros((dim, 0)), 0.0, 0
    while True:
        image, trace = product(block)
        passes += 1
        basis, products = np.hstack([basis, block]), np.hstack([products, image])
        small = basis.T @ products
        values, ways = np.linalg.eigh((small + small.T) / 2)
        values, ways = values[::-1], ways[:, ::-1]
        left = products @ ways[:, :width] - (basis @ ways[:, :width]) * values[:width]
        scale = max(values[0], 0.0)
        if scale == 0 or basis.shape[1] == dim or np.linalg.norm(left[:, :k], axis=0).max() <= CERTAIN * scale:
            break
        if passes == MOST_PASSES:
            raise RuntimeError(f"no {k} components were certified in {passes} passes")
        if basis.shape[1] + width > max(MOST_BASIS, 4 * width):
            basis, products = basis @ ways[:, : 2 * width], products @ ways[:, : 2 * width]
        block = _orthonormal(left, basis, scale)[:, : dim - basis.shape[1]]
        if not block.shape[1]:
            break
    some = [j for j in range(min(k, len(values))) if values[j] > ZERO * scale]
    components = np.linalg.qr(basis @ ways[:, some])[0] if some else np.zeros((dim, 0))
    components = components * np.where(np.take_along_axis(components, np.abs(components).argmax(axis=0)[None, :], 0)[0] < 0, -1.0, 1.0) if some else components
    model = Whitening(n, sums, components, values[some], trace, passes)

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ components / np.sqrt(model.eigenvalues)
        return (w.T @ w).ravel()

    if not some:
        return model
    white = _summed(rows, dim, len(some) ** 2, gram).reshape(len(some), -1) / n
    return replace(model, identity_error=float(np.abs(white - np.eye(len(some))).max()))


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of vectors and component of model: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors, vectors with null or infinite entries or NaN, and vectors of another length than most have (the smaller length at ties)
    are left out; so are components whose eigenvalue is zero, such as those beyond the dimensions that vary. A deviation beyond a
    long is null. Null ids stay; repeated rows: a row each, and each counts in the fit. No usable rows: no rows. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, count = model.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spread = _spread(_x(batch, dim), model.n, model.sums)
            white = (spread.astype(float) / model.n) @ model.components / np.sqrt(model.eigenvalues)
            each, rest = np.repeat(np.arange(batch.num_rows), count), batch.num_rows * count
            arrays = [
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(rest, model.n)),
                pa.array(_squares(spread), pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(model.eigenvalues / model.trace, batch.num_rows)),
                pa.array(np.full(rest, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("vector") == dim).mapInArrow(run, schema)
