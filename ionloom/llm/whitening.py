"""Whitening of embeddings by principal components that are exact to double precision.

Entries become whole numbers, `floor(256 c)`. The *fit list* is every distinct vector once. Its size, sums
and centred second moments are sums of whole numbers that Spark adds up exactly, so the covariance
does not depend on partitions or on a retried task. Its eigenvectors are found in mixed precision:
float32 eigenvectors to start with, corrected by Ogita and Aishima's matrix-multiplication iteration
in extended precision; eigenvalues closer than the iteration can tell apart are a cluster, which a
sub-solve of the shifted matrix on its subspace separates before the iteration goes on.

What grows with the data stays distributed: distinct vectors are one aggregation (partial on the map side,
so a vector that a third of all rows share is one row before the shuffle), moments are sums of
a matrix per block. The driver holds matrices of the vectors' dimension alone.

Defined cases: null vectors and vectors that hold null or non-finite entries are dropped, an empty vector
has no component and so no row; an empty table gives an empty result. Vectors of several lengths are
whitened length by length. A component without variance (one distinct vector, or dependent
dimensions) has null in `whitened` and counts for nothing in `identity_error`; where nothing varies `explained` and
`identity_error` are null. Entries outside the range of a 64-bit number stop at its ends; a
`deviation` outside of it is null. Null ids and repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import stage

SCALE = 256
COMPONENTS = 4
SWEEPS, SUB_SOLVES = 24, 4
#: Products of whole numbers are summed exactly in float64 below this.
EXACT = float(1 << 53)
#: Bytes of a block of vectors in a task.
BLOCK_BYTES = 1 << 22


def whole(vector: Column) -> Column:
    """floor(256 c) of every entry as a double, null unless all entries are finite."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.when(finite, F.transform(entry, lambda c: F.floor(c * SCALE) + F.lit(0).cast("long")))


def vectors(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    """Rows of a list column without nulls, whose lists have one size."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def blocks(batch: pa.RecordBatch, name: str, size: int) -> Iterator[np.ndarray]:
    x = vectors(batch, name, size)
    rows = max(1, BLOCK_BYTES // (8 * size))
    return (x[at : at + rows] for at in range(0, len(x), rows))


class Moments(NamedTuple):
    """Size of the fit list, sums by dimension, and n^2 times its covariance: whole numbers."""

    n: int
    sums: list[int]
    scatter: np.ndarray


def products(z: np.ndarray) -> np.ndarray:
    """z' z, exact."""
    top = float(np.abs(z).max(initial=0))
    if top * top * len(z) < EXACT:
        y = z.astype(np.float64)
        return (y.T @ y).astype(np.int64)
    return z.T.astype(object) @ z.astype(object)


def exact_sums(fit: DataFrame, size: int) -> list[int]:
    """Number of vectors, then their sum in every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=object)
        for batch in batches:
            for x in blocks(batch, "x", size):
                wide = float(np.abs(x).max()) * len(x) >= EXACT
                total += np.r_[len(x), x.sum(axis=0, dtype=object if wide else np.int64)].astype(object)
        arrays = [pa.array(range(size + 1), pa.int32()), pa.array([str(v) for v in total])]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "s"])

    parts = fit.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [int(r["s"]) for r in parts.orderBy("i").collect()]


def moments(fit: DataFrame, size: int) -> Moments:
    """Of the fit list `x`, in two passes: sums, then second moments around their rounded mean."""
    n, *sums = exact_sums(fit, size)
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = 0, 0
        for batch in batches:
            for x in blocks(batch, "x", size):
                held, count = held + products(x - centre), count + len(x)
                if count * float(np.abs(held).max(initial=0)) >= EXACT:  # later sums stay in 64 bits
                    held = held.astype(object)
        if count:
            for i in range(size):
                row = [pa.array([i], pa.int32()), pa.array([[str(v) for v in held[i]]])]
                yield pa.RecordBatch.from_arrays(row, names=["i", "sums"])

    # One matrix per task leaves it, by rows, and is added up cell by cell.
    parts = fit.mapInArrow(run, "i int, sums array<string>").select("i", F.posexplode("sums").alias("j", "s"))
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    scatter = np.zeros((size, size), dtype=object)
    for c in cells:
        scatter[c["i"], c["j"]] = int(c["s"])
    # Around the mean itself: n sum zz' - (sum z)(sum z)', z being the vectors less the rounded mean.
    offset = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], dtype=object)
    return Moments(n, sums, scatter * n - np.outer(offset, offset))


def long_double(numerator: int, denominator: int) -> np.longdouble:
    """A ratio of whole numbers, right to the last bits of an extended double."""
    ratio = Fraction(int(numerator), int(denominator))
    high = float(ratio)
    return np.longdouble(high) + np.longdouble(float(ratio - Fraction(high)))


def covariance(m: Moments) -> np.ndarray:
    """In extended precision."""
    square = m.n * m.n
    size = len(m.sums)
    out = np.zeros((size, size), dtype=np.longdouble)
    for i in range(size):
        for j in range(i + 1):
            out[i, j] = out[j, i] = long_double(m.scatter[i, j], square)
    return out


def clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Places of eigenvalues, in runs whose neighbours lie within `gap`; single ones are left out."""
    order = np.argsort(-values.astype(np.float64), kind="stable")
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > gap) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble]:
    """One iteration: (vectors, eigenvalues, the gap up to which two eigenvalues were taken as one).

    The gap measures how far `x` was from orthonormal eigenvectors.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # or rounding would turn close vectors out of square
    values = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    difference = values[None, :] - values[:, None]
    far = np.abs(difference) > gap
    quotient = (s + values[None, :] * r) / np.where(far, difference, 1)
    return x + x @ np.where(far, quotient, r / 2), values, gap


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix in extended precision.

    The iteration squares its error, so where the gap stops falling only pairs within a cluster still
    stand against each other: sub-solves part them. Converged at the rounding of the extended precision.
    """
    size = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(size, a.dtype), np.eye(size, dtype=a.dtype)
    b = a / scale
    x = np.linalg.eigh(b.astype(np.float32))[1].astype(a.dtype)
    target = 8 * size * np.finfo(a.dtype).eps * np.sqrt((b**2).sum())
    last, parted = np.inf, 0
    for _ in range(SWEEPS):
        x, values, gap = refine(b, x)
        if gap <= target:
            break
        runs = clusters(values, gap) if gap > last / 4 else []
        if runs and parted < SUB_SOLVES:
            for run in runs:
                x[:, run] = solved(b, x[:, run])
            parted += 1
        last = gap
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(size)] < 0, -1, 1)
    return values[order] * scale, x / np.sqrt((x**2).sum(axis=0))


def solved(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The vectors of a cluster turned to the eigenvectors of the matrix on their subspace.

    The cluster's centre is taken off first, so a double resolves the eigenvalues' distances and not their size.
    """
    q = orthonormal(x)
    inner = q.T @ b @ q
    centre = np.trace(inner) / len(inner)
    inner = inner - centre * np.eye(len(inner), dtype=b.dtype)
    size = np.abs(inner).max()
    return q @ np.linalg.eigh((inner / size).astype(np.float64))[1].astype(b.dtype) if size else q


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns made orthonormal in their own precision, twice over for the last bits."""
    q = x.copy()
    for _ in range(2):
        for k in range(q.shape[1]):
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
            q[:, k] /= np.sqrt((q[:, k] ** 2).sum())
    return q


class Whitening(NamedTuple):
    """A fit: moments, eigenvalues and the vectors scaled to unit variance (null ones are NaN), for the first components."""

    n: int
    sums: list[int]
    explained: list[float | None]
    basis: np.ndarray
    identity_error: float | None

    @property
    def size(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on the components; the mean is taken off before multiplying."""
        low = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([float(Fraction(s - self.n * int(c), self.n)) for s, c in zip(self.sums, low, strict=True)])
        return ((x - low).astype(np.float64) - rest) @ self.basis

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions; None outside of 64 bits."""
        sums = np.array(self.sums, dtype=object)
        bound = float(np.abs(x).max(initial=0)) * self.n + float(max(abs(s) for s in self.sums))
        if bound * bound * self.size < 2.0**62:
            return (((x * self.n - sums.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured over all of it."""
    live = np.flatnonzero(~np.isnan(model.basis).any(axis=0))
    if not len(live):
        return None
    size, k = model.size, len(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for x in blocks(batch, "x", size):
                w = model.whiten(x)[:, live]
                total += np.r_[w.sum(axis=0), (w.T @ w).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

    rows = fit.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    sums = np.array([r["s"] for r in rows]) / model.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list (column `x`, distinct vectors of one size)."""
    found = moments(fit, size)
    v = covariance(found)
    values, basis = eigenvectors(v)
    trace = np.trace(v)
    k = min(components, size)
    dead = values[:k] <= trace * size * np.finfo(np.float64).eps
    scaled = np.where(dead, np.nan, basis[:, :k] / np.sqrt(np.where(dead, 1, values[:k]))).astype(np.float64)
    explained = [float(max(e, 0) / trace) if trace > 0 else None for e in values[:k]]
    model = Whitening(found.n, found.sums, explained, scaled, None)
    return model._replace(identity_error=identity_error(fit, model))


def fit_list(rows: DataFrame) -> DataFrame:
    return rows.select("x").distinct()


def whitened(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    rows = embeddings.select(F.col(id_column), whole(F.col(vector_column)).alias("x")).filter("x is not null and size(x) > 0")
    fit = stage(fit_list(rows), "fit_list")
    sizes = sorted(r["n"] for r in fit.select(F.size("x").alias("n")).distinct().collect())
    kind = rows.schema[0].dataType.simpleString()
    spec = f"`{id_column}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    parts = []
    for size in sizes:
        model = fit_whitening(fit.filter(F.size("x") == size), size, components)
        parts.append(rows.filter(F.size("x") == size).mapInArrow(applied(model, id_column), spec))
    if not parts:
        return embeddings.sparkSession.createDataFrame([], spec)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def applied(model: Whitening, id_column: str):
    """The map of a batch of (id, x) to one row per component."""
    k = model.basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch, "x", model.size)
            w, n = model.whiten(x).ravel(), len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            arrays = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), deviation,
                pa.array(w, mask=np.isnan(w)), pa.array(model.explained * n, pa.float64()),
                pa.array([model.identity_error] * (n * k), pa.float64()),
            ]
            names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run
