"""Embedding whitening by spectral divide and conquer on polar decompositions.

Entries become whole numbers floor(scale * c) + offset; a vector that occurs in several rows counts once.
Sums over distinct vectors are exact; a second pass over them gathers the centred covariance, one partial
matrix per task. The polar factor of the covariance minus a shift, found by dynamically weighted Halley
steps (QDWH), has eigenvalues of plus and minus one on the two sides of the shift; it gives the projectors
on both invariant subspaces, an orthonormal basis of each, and two smaller problems, until a basis vector
is left. The driver holds only matrices of dimension x dimension. The chosen components, scaled, go to the tasks as a
constant of components x dimension numbers, and a third pass measures the covariance of the result.

Rows whose vector is null, or holds a null or non-finite entry, are dropped, as are vectors without entries
and those whose length is not the most frequent one (the larger of equally frequent). Finite entries beyond
2**40 / scale are taken as that bound. A null or repeated id is kept: each row is whitened. Equal
eigenvalues share a space; any orthonormal basis of it serves, and the same one for all rows. Components
whose share of the variance is below 1e-12 cannot be scaled and are left out; without variance, as in a
table of one distinct vector, or an empty one, there are no rows. A deviation beyond a long is null. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.sources.store import materialise

_LARGEST = float(1 << 40)
_EPS = np.finfo(float).eps


class Shape(NamedTuple):
    """Steps of a unit, added to each entry, most components, least share of the variance."""

    scale: int = 64
    offset: int = 1_000_000
    components: int = 16
    share: float = 1e-12


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by QDWH steps with QR factorisations.

    ``low`` bounds the smallest singular value of the iterate from below; weights follow from it, so that six
    steps do for a condition of 1 / eps. Singular values near nothing stay where they are.
    """
    x = a / np.linalg.norm(a)
    n = len(a)
    low = max(np.linalg.norm(x, -2), _EPS) / 2  # of at most dimension x dimension numbers
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        g = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * root), 0)) / 2
        b = (g - 1) ** 2 / 4
        c = g + b - 1
        q, _r = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + (g - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (g + b * low * low) / (1 + c * low * low), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(_EPS) * 1e-2 and 1 - low < 1e-8:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal columns that span a projector's range: its longest columns, made orthogonal one by one."""
    rest, chosen = projector.copy(), []
    for _ in range(rank):
        column = rest[:, np.argmax((rest * rest).sum(0))]
        for _twice in range(2):
            for v in chosen:
                column = column - v * (v @ column)
        column = column / np.linalg.norm(column)
        chosen.append(column)
        rest -= np.outer(column, column @ rest)
    return np.array(chosen).T


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix."""
    n = len(v)
    found = np.zeros((n, 0))
    scale = np.linalg.norm(v)
    pending = [np.eye(n)]
    while pending:
        basis = pending.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        k = len(a)
        shift = np.trace(a) / k  # strictly between the least and the largest eigenvalue, unless all are equal
        if k == 1 or np.linalg.norm(a - shift * np.eye(k)) <= 4 * _EPS * scale:
            found = np.hstack([found, basis])
            continue
        sign = polar(a - shift * np.eye(k))
        rank = min(max(int(round((np.trace(sign) + k) / 2)), 1), k - 1)
        upper = _basis((np.eye(k) + sign) / 2, rank)
        both = np.hstack([upper, _basis((np.eye(k) - sign) / 2, k - rank)])
        both, _r = np.linalg.qr(both)
        pending += [basis @ both[:, :rank], basis @ both[:, rank:]]
    return _polished(v, found)


def _polished(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One or two steps towards orthogonal columns and a diagonal matrix, from columns that nearly are."""
    for _ in range(3):
        gram, a = x.T @ x, x.T @ v @ x
        values = np.diag(a) / np.diag(gram)
        off = np.eye(len(v)) - gram
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > 1e-7 * np.abs(values).max()
        turn = np.where(far, (a + values[None, :] * off) / np.where(far, gap, 1), off / 2)
        np.fill_diagonal(turn, np.diag(off) / 2)
        x = x + x @ turn
    for _ in range(2):  # nearly orthogonal columns become so by the shortest way
        x = 1.5 * x - 0.5 * x @ (x.T @ x)
    values = np.einsum("ij,ik,kj->j", x, v, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def _rows(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _partial(df: DataFrame, dim: int, size: int, made) -> np.ndarray:
    """Sum over tasks of a size x size matrix that each task gathers from its batches; rows are summed in Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                total += made(_rows(batch, "x", dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size), pa.int32()), pa.array(np.tile(np.arange(size), size), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    sums = df.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for r in sums.collect():  # dimension x dimension numbers
        out[r["i"], r["j"]] = r["v"]
    return out


class Fit(NamedTuple):
    """Distinct vectors, sums per dimension, eigenvalues, unit eigenvectors as rows, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _moments(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums; a task's sums are added in Spark as decimals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total = [a + int(b) for a, b in zip(total, _rows(batch, "x", dim).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "v"])

    sums = distinct.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in sums.collect()}  # dimension + 1 numbers
    return found[-1], [found[i] for i in range(dim)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n to double precision: whole part first, then the remainder."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(float) - rest


def fit(distinct: DataFrame, dim: int, shape: Shape = Shape()) -> Fit:
    """Spectrum of the covariance of the distinct vectors (column x)."""
    n, sums = _moments(distinct, dim)

    def gathered(x: np.ndarray) -> np.ndarray:
        d = _centred(x, n, sums)
        return d.T @ d

    v = _partial(distinct, dim, dim, gathered) / n
    v = (v + v.T) / 2
    values, vectors = eigenvectors(v)
    trace = float(np.trace(v))
    kept = int((values > shape.share * trace).sum()) if trace > 0 else 0
    kept = min(kept, shape.components)
    return Fit(n, sums, values[:kept], vectors.T[:kept], trace)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n * x - sums) ** 2, exact; null where it exceeds a long."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n for s in sums], np.int64)
    d = x - whole
    widest = int(np.abs(d).max(initial=0)) * n + n
    if widest * widest * x.shape[1] < 1 << 63:
        e = d * n - part
        return pa.array((e * e).sum(1), pa.int64())
    exact = (sum((a * n - b) ** 2 for a, b in zip(row, part.tolist())) for row in d.tolist())
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shape: Shape = Shape()) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error per row and component."""
    kind = vectors.schema[key].dataType.simpleString()
    spec = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    entry = F.col("v")
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bound = F.lit(_LARGEST)
    number = F.transform(entry, lambda c: (F.floor(F.greatest(F.least(c * shape.scale, bound), -bound)) + shape.offset).cast("long"))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(usable).select("key", number.alias("x"))
    rows = materialise(rows, "vectors")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], spec)
    dim = common["d"]
    rows = rows.filter(F.size("x") == dim)
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, dim, shape)
    k = len(model.values)
    scaled = model.vectors / np.sqrt(model.values)[:, None] if k else model.vectors
    n, sums = model.n, model.sums

    def project(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums) @ scaled.T

    error = 0.0
    if k:
        error = float(np.abs(_partial(distinct, dim, k, lambda x: (w := project(x)).T @ w) / n - np.eye(k)).max())
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0 or k == 0:
                continue
            m = batch.num_rows
            x = _rows(batch, "x", dim)
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column("key").take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                       _deviation(x, n, sums).take(again), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, spec)
