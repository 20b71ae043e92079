"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers (``floor(scale * c)``), and every distinct one counts once in the fit. X is the table of
these, centred; it is never held: it lies in blocks in the shared checkpoint folder, and a step of the bidiagonalisation is
two passes over them. The first takes X v, the second X^T u. A left vector u is as long as the table; it lies in the
range of X, so what is kept of it is p with u = X p, as long as a row, and each pass makes its part of u anew. Both
passes also take the products of the new u with all earlier ones, so every left vector is made orthogonal to all
others twice, and so is every right one. What a task gives back is a few sums for each dimension, and there are few
tasks for each core, so that what the driver adds up doesn't grow with the table; rows are centred
before they are multiplied.

The small bidiagonal matrix B has the singular values of X; the right singular vectors of B turn the right vectors into
components. The process ends early only if it is proven that nothing is missing: the residuals of the wanted
components are of the order of rounding, and the energy of X outside the right vectors (its exact trace less
the squares of B) is less than that of the last wanted component, so that no direction outside can have more. Otherwise
it goes on to the full dimension, starting anew at random where it breaks down (equal eigenvalues, low rank).

Defined results: vectors that are null or hold nulls or entries that aren't finite are left out; shorter vectors are filled up
with zeros to the longest; an entry beyond 2^53 counts as 2^53; repeated vectors are fitted once and returned each;
equal eigenvalues have any orthonormal basis, the same for all rows; directions without variance are no components,
so a table of fewer than two distinct vectors, an empty one included, gives no rows; ``deviation`` is null where it exceeds
a long; null and repeated identifiers stay as they are; other columns of the input, whatever their names, aren't looked at.
Very long vectors make a driver's share of (steps x dimensions) numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed

#: Whole numbers of doubles end here.
MOST = 1 << 53
BLOCK_BYTES = 1 << 20
TASK_BYTES = 8 << 20
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class WhiteningPolicy:
    components: int = 4
    scale: int = 256
    seed: int = 7


@dataclass(frozen=True)
class Basis:
    """What a fit gives: number of vectors, sums, eigenvalues (falling), components as columns, variance in all."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vectors: DataFrame, policy: WhiteningPolicy = WhiteningPolicy(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors as arrays of longs, all as long as the longest one."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(fine)
    most = F.lit(float(MOST))
    bounded = lambda c: F.floor(F.greatest(F.least(c * policy.scale, most), -most)).cast("long")
    rows = rows.select("id", F.transform("v", bounded).alias("x"))
    width = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    if width[0] == width[1]:
        return rows
    return rows.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width[0]) - F.size("x"))).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def _packed(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rows = max(1, BLOCK_BYTES // (8 * max(d, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for i in range(0, len(x), rows):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + rows].astype("<i8").tobytes()], pa.binary())], ["block"])

    return run


def _summed(blocks: DataFrame, d: int, sums_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all blocks of ``sums_of`` (whole-number rows to an array of doubles). A task adds up its blocks and gives one row back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                got = sums_of(np.frombuffer(block.as_py(), "<i8").reshape(-1, d)).ravel()
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return sum((np.array(r.sums) for r in blocks.mapInArrow(run, "sums array<double>").collect()), np.zeros(1))


def _exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows, and sums of each dimension without rounding: of upper and lower 27 bits by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for block in batch.column(0):
                x = np.frombuffer(block.as_py(), "<i8").reshape(-1, d)
                n, high, low = n + len(x), high + (x >> 27).sum(0), low + (x & (1 << 27) - 1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([[n, *high.tolist(), *low.tolist()]], pa.list_(pa.int64()))], ["sums"])

    total = [0] * (2 * d + 1)
    for r in blocks.mapInArrow(run, "sums array<long>").collect():
        total = [a + b for a, b in zip(total, r.sums, strict=True)]
    return total[0], [(total[1 + k] << 27) + total[1 + d + k] for k in range(d)]


def bidiagonalise(blocks: DataFrame, n: int, mean: np.ndarray, policy: WhiteningPolicy) -> tuple[np.ndarray, np.ndarray, float]:
    """Squares of the wanted singular values of the centred table (falling), right singular vectors as columns, and the sum of all squares."""
    d = len(mean)
    energy = float(_summed(blocks, d, lambda x: ((x - mean) ** 2).sum(0)).sum())
    if energy <= 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    rng = np.random.default_rng(policy.seed)
    tiny = EPS * energy**0.5 * max(8, d**0.5)
    right, left, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v; p with u = X p; X^T u
    alphas, betas = [], []

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    def fresh() -> np.ndarray:
        w = orthogonal(rng.standard_normal(d))
        return w / np.linalg.norm(w)

    v, beta = fresh(), 0.0
    while True:
        # X v: what of it lies along earlier left vectors
        along = _summed(blocks, d, lambda x, p=left, v=v: (lambda c: (c @ p).T @ (c @ v))(x - mean)) if left.shape[1] else np.zeros(0)
        p = v - left @ along
        # X^T u, and once more what lies along them, and the length
        got = _summed(blocks, d, lambda x, q=left, p=p: (lambda c, u: np.concatenate([c.T @ u, [u @ u], (c @ q).T @ u]))(c := x - mean, c @ p))
        image, square, again = got[:d], got[d], got[d + 1 :]
        p, image = p - left @ again, image - images @ again
        alpha = max(square - again @ again, 0.0) ** 0.5
        right = np.column_stack([right, v])
        if alpha > tiny:
            p, image = p / alpha, image / alpha
        else:  # v has no image of its own: a column of zeros
            alpha, p, image = 0.0, np.zeros(d), np.zeros(d)
        left, images = np.column_stack([left, p]), np.column_stack([images, image])
        alphas.append(alpha)
        betas.append(beta)
        b = np.diag(alphas) + np.diag(betas[1:], 1)
        u, s, vt = np.linalg.svd(b)
        k = min(policy.components, len(s))
        if right.shape[1] == d:
            break
        w = orthogonal(image - alpha * v)
        beta = float(np.linalg.norm(w))
        outside = energy - float((b**2).sum())
        settled = np.abs(beta * u[-1, :k]).max() <= 4 * EPS * s[0]
        if k == policy.components and settled and outside < s[k - 1] ** 2 * (1 - 1e-9):
            break
        v, beta = (w / beta, beta) if beta > tiny else (fresh(), 0.0)
    kept = s[:k] > max(n, d) * EPS * s[0]
    return (s[:k] ** 2)[kept], (right @ vt[:k].T)[:, kept], energy


def fit(numbers: DataFrame, policy: WhiteningPolicy = WhiteningPolicy()) -> tuple[Basis | None, DataFrame]:
    """The basis of the distinct vectors of (id, x), none if there is no variance, and the blocks of the fit."""
    first = numbers.select(F.size("x").alias("d")).first()
    d = first.d if first else 0
    # a task reads many blocks, one after the other, and gives one row of sums to the driver: few tasks for a core
    tasks = min(numbers.count() * d * 8 // TASK_BYTES + 1, 4 * numbers.sparkSession.sparkContext.defaultParallelism)
    blocks = checkpointed(numbers.select("x").distinct().mapInArrow(_packed(d), "block binary").coalesce(tasks))
    n, sums = _exact_sums(blocks, d) if d else (0, [])
    if n < 2:
        return None, blocks
    squares, components, energy = bidiagonalise(blocks, n, np.array([s / n for s in sums]), policy)
    return (Basis(n, sums, squares / n, components, energy / n) if len(squares) else None), blocks


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exactly; None beyond a long."""
    most = n * max(int(x.max()), -int(x.min())) + max(abs(s) for s in sums) if x.size else 0
    if x.shape[1] * most**2 < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def identity_error(blocks: DataFrame, basis: Basis) -> float:
    """Largest absolute entry of the covariance of whitened vectors less the identity, over the fit."""
    d, k, mean, turned = len(basis.sums), len(basis.values), basis.mean, basis.components / np.sqrt(basis.values)
    center = _summed(blocks, d, lambda x: ((x - mean) @ turned).sum(0)) / basis.n
    gram = _summed(blocks, d, lambda x: (lambda w: w.T @ w)((x - mean) @ turned - center)).reshape(k, k) / basis.n
    return float(np.abs(gram - np.eye(k)).max())


def whiten(vectors: DataFrame, policy: WhiteningPolicy = WhiteningPolicy(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id (as ``id_col`` is named), component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector left and component."""
    numbers = checkpointed(whole_numbers(vectors, policy, id_col, vector_col))
    kind = numbers.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    basis, blocks = fit(numbers, policy)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, k, d = identity_error(blocks, basis), len(basis.values), len(basis.sums)
    mean, turned, explained = basis.mean, basis.components / np.sqrt(basis.values), basis.values / basis.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("id").take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, basis.n, np.int64)),
                pa.array(deviations(x, basis.n, basis.sums), pa.int64()).take(at),
                pa.array(((x - mean) @ turned).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.mapInArrow(run, schema).withColumnRenamed("id", id_col)
