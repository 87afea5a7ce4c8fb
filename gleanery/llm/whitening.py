"""Embedding whitening on a distributed, centred covariance.

Vectors become whole numbers, each distinct vector counts once. Every task sums its part
of them and the products of their centred entries; two parts are joined by the offset of
their means, so products are centred throughout and one pass is enough. The matrix, whose
size depends on the number of dimensions alone, is brought to tridiagonal form by
Householder reflections; Sturm counts bisect its leading eigenvalues, and inverse iteration
gives their vectors, made orthogonal to those of close eigenvalues. The components
are sent to all tasks and every row is projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gleanery.operators.storage import settle

STEPS = 256
#: Whole numbers stay within this, so that they are exact as doubles; larger entries count as this.
LARGEST = 1 << 52
_HALF = 26
_SLOTS = 32


# ---- eigenvalues and vectors of a symmetric matrix

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with Q' M Q tridiagonal, by Householder reflections."""
    m = matrix.astype(np.float64).copy()
    n = len(m)
    q = np.eye(n)
    for k in range(n - 2):
        x = m[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.linalg.norm(x)
        block = m[k + 1:, k + 1:]
        p = block @ x
        p -= (x @ p) * x
        block -= 2 * (np.outer(x, p) + np.outer(p, x))
        column = m[k + 1:, k] - 2 * x * (x @ m[k + 1:, k])
        m[k + 1:, k] = m[k, k + 1:] = column
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ x, x)
    return np.diag(m).copy(), np.diag(m, 1).copy(), q


def count_below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than x: negative terms of its Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares, count, d = np.concatenate([[0.0], off * off]), 0, 1.0
    for a, s in zip(diagonal, squares):
        d = a - x - s / d
        if abs(d) < tiny:
            d = -tiny
        count += d < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = float(np.min(diagonal - reach)), float(np.max(diagonal + reach))
    pad = 1e-12 * max(abs(low), abs(high), np.finfo(float).tiny)
    out = []
    for i in range(k):
        a, b = low - pad, high + pad
        while True:
            middle = 0.5 * (a + b)
            if not a < middle < b or b - a <= 2 * np.finfo(float).eps * abs(middle):
                break
            if count_below(diagonal, off, middle) >= len(diagonal) - i:
                b = middle
            else:
                a = middle
        out.append(0.5 * (a + b))
    return np.array(out)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, floor: float) -> np.ndarray:
    """Solve (T - shift) y = right by elimination with row exchanges; pivots stay above ``floor``."""
    n = len(diagonal)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    y = right.copy()
    for i in range(n - 1):
        below = off[i]
        if abs(below) > abs(main[i]):
            main[i], below = below, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(main[i]) < floor:
            main[i] = floor
        factor = below / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        y[i + 1] -= factor * y[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            y[i] -= upper[i] * y[i + 1]
        if i + 2 < n:
            y[i] -= second[i] * y[i + 2]
        y[i] /= main[i]
    return y


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close values are made orthogonal to each other."""
    n = len(diagonal)
    scale = max(float(np.max(np.abs(diagonal), initial=0)), float(np.max(np.abs(off), initial=0)), np.finfo(float).tiny)
    floor, close = np.finfo(float).eps * scale, 1e-3 * scale
    start = np.random.default_rng(5)
    out = np.zeros((n, len(values)))
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close:
            cluster = i
        y = start.standard_normal(n)
        for _ in range(rounds):
            y = _solve_shifted(diagonal, off, value, y / np.max(np.abs(y)), floor)
            for _ in range(2):
                y -= out[:, cluster:i] @ (out[:, cluster:i].T @ y)
            y /= np.linalg.norm(y)
        out[:, i] = y
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix and their unit vectors, as columns."""
    scale = float(np.max(np.abs(matrix), initial=0))
    k = min(k, len(matrix))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, q = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    return values * scale, q @ vectors_of(diagonal, off, values)


# ---- sums over tasks

@dataclass
class Moments:
    """Number of rows, sums of entries (exact where they are whole), and sums of products of centred entries."""
    n: int
    sums: list
    products: np.ndarray

    @classmethod
    def none(cls, dims: int) -> Moments:
        return cls(0, [0] * dims, np.zeros((dims, dims)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a batch, rows by dimensions."""
        if x.dtype.kind == "i":
            high, low = (x >> _HALF).sum(axis=0), (x & ((1 << _HALF) - 1)).sum(axis=0)
            sums = [(int(h) << _HALF) + int(b) for h, b in zip(high, low)]
        else:
            sums = x.sum(axis=0).tolist()
        centred = x - np.array([s / len(x) for s in sums])
        return cls(len(x), sums, centred.T @ centred)

    def add(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if other.n else self
        n = self.n + other.n
        # whole sums: the exact difference over both counts, rounded once
        apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        joined = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums)], joined)

    def row(self, slot: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([slot], pa.int32()), pa.array([self.n], pa.int64()), pa.array([[repr(s) for s in self.sums]], pa.list_(pa.string())),
             pa.array([self.products.ravel()], pa.list_(pa.float64()))], names=_NAMES)

    @classmethod
    def read(cls, table: pa.Table, dims: int) -> Moments:
        out = cls.none(dims)
        for n, sums, products in zip(*(table.column(c).to_pylist() for c in _NAMES[1:])):
            sums = [float(s) if "." in s or "e" in s else int(s) for s in sums]
            out = out.add(cls(n, sums, np.array(products).reshape(dims, dims)))
        return out


_NAMES = ["slot", "n", "sums", "products"]
_SCHEMA = "slot int, n long, sums array<string>, products array<double>"


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def moments(vectors: DataFrame, dims: int, out_dims: int, project=None) -> Moments:
    """Moments of all rows of x, or of what ``project`` makes of them: a row a task, joined in ``_SLOTS`` groups, and those on the driver."""
    def partial(batches):
        found = Moments.none(out_dims)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, dims)
                found = found.add(Moments.of(x if project is None else project(x)))
        yield found.row(TaskContext.get().partitionId() % _SLOTS)

    def joined(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Moments.read(table, out_dims).row(table.column("slot")[0].as_py())])

    parts = vectors.select("x").mapInArrow(partial, _SCHEMA).groupBy("slot").applyInArrow(joined, _SCHEMA)
    return Moments.read(parts.toArrow(), out_dims)


@dataclass
class Whitening:
    """Moments of the distinct vectors, eigenvalues above zero, and their components as columns."""
    moments: Moments
    trace: float
    values: np.ndarray
    components: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.moments.n for s in self.moments.sums])
        return (x - mean) @ self.components / np.sqrt(self.values)


def whole_vectors(df: DataFrame, column: str, keep: list[str], dims: int) -> DataFrame:
    """The rows whose vector has ``dims`` entries, all finite, with x = floor(256 * entry)."""
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            held = vectors.filter(pc.equal(vectors.value_lengths().fill_null(0), dims))
            flat = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            fine = np.isfinite(flat).all(axis=1)
            x = np.clip(np.floor(STEPS * flat[fine]), -LARGEST, LARGEST).astype(np.int64)
            rows = pc.indices_nonzero(pc.equal(vectors.value_lengths().fill_null(0), dims)).take(pa.array(np.flatnonzero(fine)))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                                             names=[*keep, "x"])

    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(column).alias("vector")).mapInArrow(run, ", ".join([*fields, "x array<long>"]))


def fit(vectors: DataFrame, dims: int, k: int) -> Whitening:
    """Whitening of the vectors of a frame with column x, each one once however often it comes."""
    found = moments(vectors, dims, dims)
    if not found.n:
        return Whitening(found, 0.0, np.zeros(0), np.zeros((dims, 0)))
    covariance = found.products / found.n
    values, components = leading_components(covariance, k)
    above = values > dims * np.finfo(float).eps * max(values[0], 0.0) if len(values) else values > 0
    return Whitening(found, float(np.trace(covariance)), values[above], components[:, above])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured in a pass of its own."""
    k = len(model.values)
    if not k:
        return 0.0
    found = moments(vectors, len(model.components), k, model.whiten)
    return float(np.max(np.abs(found.products / found.n - np.eye(k))))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum) squared, exact; None where it does not fit a long."""
    widest = max([n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + abs(s) for s in sums], default=0)
    if widest * widest * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def dimensions(df: DataFrame, column: str) -> int:
    """The most frequent number of entries of a vector, the larger one of two as frequent; 0 without any."""
    n = F.size(column).alias("dims")
    top = df.filter(F.size(column) > 0).groupBy(n).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return top["dims"] if top else 0


def whiten(df: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = 4) -> DataFrame:
    """A row per vector and component: the key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, has a null, infinite or NaN entry, or another number of entries
    than most, are left out; further columns, whatever their names, are not read. Repeated rows
    and vectors keep all their rows but count once in the fit. Components without variance
    (fewer distinct vectors than dimensions) are left out, so equal vectors alone give no
    rows, as does an empty table. Ties between eigenvalues: some orthogonal pair, the same for all rows.
    A deviation beyond a long is null; entries beyond 2**44 count as that.
    """
    dims = dimensions(df, column)
    rows = whole_vectors(df, column, [key], dims) if dims else None
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if rows is None:
        return df.sparkSession.createDataFrame([], schema)
    distinct = settle(rows.select("x").distinct())
    model = fit(distinct, dims, k)
    error = identity_error(distinct, model)
    found, explained = model.moments, model.values / model.trace if model.trace else model.values
    components = len(model.values)

    def run(batches):
        for batch in batches:
            x = _rows(batch, dims)
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(x)), components)))
            deviation = pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), components)))
            many = len(x) * components
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(x))), pa.array(np.full(many, found.n)), deviation,
                 pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
