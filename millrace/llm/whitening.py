"""Whitening of embeddings by a compensated covariance.

Vectors become integers, and each distinct one counts once. Sums and centred outer products are accumulated as pairs of a high and a low double
(double-double): products and sums go through error-free transformations, each task adds its rows up in a tree, and the high and low parts of the
tasks are merged in the order of the tasks, block by block of the cells, so no task holds more than two blocks and reruns agree. Only the covariance,
a square of the dimensions, comes to the driver. Its eigenvectors are found by reduction to tridiagonal form and divide and conquer
(LAPACK's ``syevd``, which ``numpy.linalg.eigh`` calls), then corrected against the covariance in extended precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, settle
from millrace.llm.vectors import matrix, usable

#: Integer steps of a unit; components returned.
STEPS, COMPONENTS = 256, 4
#: Cells of a block that is merged as one row; cells that a tree of sums works on at once.
_BLOCK, _AT_ONCE = 4096, 1 << 19

#: A double-double: high and low part.
Pair = tuple[np.ndarray, np.ndarray]


def _two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    """Two parts of 26 bits that add up to ``a``."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def _two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error, exactly."""
    p, (ah, al), (bh, bl) = a * b, _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _renormalise(high: np.ndarray, low: np.ndarray) -> Pair:
    s = high + low
    return s, low - (s - high)


def add(a: Pair, b: Pair) -> Pair:
    s, e = _two_sum(a[0], b[0])
    t, f = _two_sum(a[1], b[1])
    s, e = _renormalise(s, e + t)
    return _renormalise(s, e + f)


def total(rows: Pair) -> Pair:
    """The sum of all rows, added up in a tree."""
    high, low = rows
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([x, np.zeros_like(x[:1])]) for x in (high, low))
        half = len(high) // 2
        high, low = add((high[:half], low[:half]), (high[half:], low[half:]))
    return high[0], low[0]


def plain(x: np.ndarray) -> Pair:
    """The cells of a sum: the entries themselves."""
    return x, np.zeros_like(x)


def centre(x: np.ndarray, mean: Pair) -> Pair:
    s, e = _two_sum(x, -mean[0])
    return _renormalise(s, e - mean[1])


def outer(x: np.ndarray, mean: Pair) -> Pair:
    """The cells of centred outer products, those on and above the diagonal."""
    high, low = centre(x, mean)
    i, j = np.triu_indices(x.shape[1])
    p, e = _two_product(high[:, i], high[:, j])
    return _renormalise(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j]))


_PARTS = "block int, task int, high binary, low binary"


def accumulate(df: DataFrame, vector: str, dim: int, cells: Callable[[np.ndarray], Pair]) -> Pair:
    """Sum over all rows of the cells that ``cells`` makes of an array of vectors (rows by ``dim``), as double-double."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: Pair | None = None
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            step = max(1, _AT_ONCE // max(1, dim * (dim + 1) // 2))
            for at in range(0, len(x), step):
                part = total(cells(x[at : at + step]))
                so_far = add(so_far, part) if so_far else part
        if so_far:
            blocks = range(0, len(so_far[0]), _BLOCK)
            yield pa.record_batch(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()), *(pa.array([half[b : b + _BLOCK].tobytes() for b in blocks], pa.binary()) for half in so_far)], ["block", "task", "high", "low"]
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([0], pa.int32()), *(pa.array([half.tobytes()], pa.binary()) for half in so_far)], ["block", "task", "high", "low"])

        for batch in batches:
            for row in batch.to_pylist():
                part = np.frombuffer(row["high"]), np.frombuffer(row["low"])
                if row["block"] != at:
                    if so_far:
                        yield done()
                    at, so_far = row["block"], part
                else:
                    so_far = add(so_far, part)
        if so_far:
            yield done()

    parts = df.select(vector).mapInArrow(of_task, _PARTS).repartition("block").sortWithinPartitions("block", "task").mapInArrow(merged, _PARTS)
    blocks = sorted(parts.select("block", "high", "low").collect())
    return tuple(np.concatenate([np.frombuffer(b[side]) for b in blocks]) if blocks else np.zeros(0) for side in ("high", "low"))


def mean_of(sums: Pair, n: int) -> Pair:
    """A double-double divided by a count."""
    high = sums[0] / n
    p, e = _two_product(high, np.full_like(high, float(n)))
    return _renormalise(high, ((sums[0] - p) - e + sums[1]) / n)


def covariance(products: Pair, dim: int, n: int) -> np.ndarray:
    """The whole matrix of the summed cells, with divisor n, in extended precision."""
    out = np.zeros((dim, dim), np.longdouble)
    out[np.triu_indices(dim)] = (products[0].astype(np.longdouble) + products[1]) / n
    return np.triu(out) + np.triu(out, 1).T


def eigen(v: np.ndarray) -> Pair:
    """Eigenvalues, falling, and unit eigenvectors as columns.

    Two steps of iterative refinement in extended precision bring the vectors to the full precision of a double; within a cluster of equal eigenvalues they are made orthogonal only.
    What vectors of nearly equal eigenvalues have lost of their right angles is put right at last."""
    v = v.astype(np.longdouble)
    q = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        r, s = np.eye(len(v)) - q.T @ q, q.T @ v @ q
        e = np.diag(s) / (1 - np.diag(r))
        near = 2 * (np.abs(s - np.diag(e)).max() + np.abs(v).max() * np.abs(r).max())
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        q = q + q @ np.where(apart, (s + r * e[None, :]) / np.where(apart, gap, 1), r / 2)
    q = q + q @ (np.eye(len(v)) - q.T @ q) / 2
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


@dataclass
class Whitening:
    """n distinct vectors, their exact sums, their mean as double-double, the projections (columns) that whiten, each one's share of the variance, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    mean: Pair
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = centre(x.astype(np.float64), self.mean)
        return high @ self.projection + low @ self.projection

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; null where a long can't hold it."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [d if d < 1 << 63 else None for d in exact]


def fit(vectors: DataFrame, vector: str, dim: int, components: int) -> Whitening | None:
    """The whitening of distinct integer vectors; None without any. Components without variance are left out."""
    n = vectors.count()
    if not n or not dim:
        return None
    sums = accumulate(vectors, vector, dim, plain)
    mean = mean_of(sums, n)
    e, q = eigen(v := covariance(accumulate(vectors, vector, dim, lambda x: outer(x, mean)), dim, n))
    rank = int((e > v.trace() * 1e-14).sum())
    e, q = e[: min(components, rank)], q[:, : min(components, rank)]
    out = Whitening(n, [int(h) + int(low) for h, low in zip(*sums, strict=True)], mean, (q / np.sqrt(e)).astype(np.float64), (e / v.trace() if rank else e).astype(np.float64), 0.0)
    if k := len(e):
        middle = mean_of(accumulate(vectors, vector, dim, lambda x: plain(out(x))), n)
        found = covariance(accumulate(vectors, vector, dim, lambda x: outer(out(x), middle)), k, n)
        out.identity_error = float(np.abs(found - np.eye(k)).max())
    return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row (key, component, n, deviation, whitened, explained, identity_error) for each row with a usable vector and each of the first ``components`` components.

    Each entry c becomes floor(256 c). Rows whose vector is null, holds a null or a non-finite entry or is of another length than most are dropped. Equal vectors count once in the
    fit and are whitened alike; repeated rows and rows with a null key each get their rows. Components without variance are left out, so one distinct vector, empty vectors
    or an empty table give no row. ``deviation`` is null where a long can't hold it. Other columns are ignored."""
    kept, dim = usable(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")), "v")
    scaled = kept.select("key", F.transform("v", lambda c: F.floor(c * STEPS)).alias("x"))
    distinct = settle(scaled.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, "x", dim, components)
    discard(distinct)
    names = (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(*x) for x in names)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(model.explained) if model else 0
            if not k or not len(batch):
                continue
            x = matrix(batch.column(1), dim)
            of, numbers = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
            columns = [
                batch.column(0).take(pa.array(of)), pa.array(numbers + 1, pa.int32()), pa.array(np.full(len(of), model.n), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(pa.array(of)),
                pa.array(model(x).ravel()), pa.array(model.explained[numbers]), pa.array(np.full(len(of), model.identity_error)),
            ]
            yield pa.record_batch(columns, [key, *(name for name, _ in names)])

    return scaled.mapInArrow(rows, schema)
