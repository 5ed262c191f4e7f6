"""Whitening of embeddings along principal components found by spectral divide and conquer.

Spark makes the sums over the vectors; what the driver sees is one covariance matrix, whose
size follows the dimension and never the number of rows. Its components come from polar
decompositions (QDWH) of the shifted covariance, which give projectors onto invariant subspaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.rows import col
from flowlens.session import materialize

SCALE = 256
LONGEST = 2**63 - 1


def polar(matrix: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    n, eps = len(matrix), np.finfo(float).eps
    x, low, eye = matrix / np.linalg.norm(matrix), eps, np.eye(len(matrix))
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            step = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        else:
            step = b / c * x + (a - b / c) * np.linalg.solve(eye + c * x @ x, x)
        step = (step + step.T) / 2
        change, x = np.linalg.norm(step - x), step
        low = min(low * (a + b * square) / (1 + c * square), 1.0)
        if change < 1e-10 and 1 - low < 1e-10:
            break
    return x


def split(matrix: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvalues above a shift; None for a multiple of I."""
    n, eye = len(matrix), np.eye(len(matrix))
    middle = np.trace(matrix) / n
    spread = np.linalg.norm(matrix - middle * eye)
    if spread <= 4 * np.finfo(float).eps * n * np.linalg.norm(matrix):
        return None
    rng = np.random.default_rng(n)
    for trial in range(2 * n + 10):  # an eigenvalue at the shift spoils the projector: another shift
        shift = middle + (-1) ** trial * (trial * 0.618034 % 1) * spread / n
        projector = (polar(matrix - shift * eye) + eye) / 2
        k = int(round(np.trace(projector)))
        if 0 < k < n and np.linalg.norm(projector @ projector - projector) < 1e-10 * n:
            basis = np.linalg.qr(projector @ rng.standard_normal((n, k)), mode="complete")[0]
            return np.linalg.qr(np.hstack([projector @ basis[:, :k], basis[:, k:] - projector @ basis[:, k:]]))[0], k
    return None


def components(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by splitting invariant subspaces."""
    matrix = (matrix + matrix.T) / 2
    found, open_ = [], [np.eye(len(matrix))]
    while open_:
        basis = open_.pop()
        inner = basis.T @ matrix @ basis
        halves = split((inner + inner.T) / 2) if basis.shape[1] > 1 else None
        if halves is None:
            found.append(basis)
        else:
            turned, k = halves
            open_ += [basis @ turned[:, :k], basis @ turned[:, k:]]
    vectors = np.linalg.qr(np.hstack(found))[0] if found else matrix
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _row_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sum per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dim, [0] * dim
        for batch in batches:  # halves of the entries, so that no sum of a batch can overflow
            x = _matrix(batch.column("x"), dim)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 32).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFFFFF).sum(axis=0))]
        if n:
            total = [Decimal((a << 32) + b) for a, b in zip(high, low)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(total, pa.decimal128(38, 0))],
                names=["i", "n", "total"])

    rows = fit.mapInArrow(sums, "i int, n long, total decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not rows:
        return 0, [0] * dim
    return rows[0]["n"], [int(r["total"]) for r in sorted(rows, key=lambda r: r["i"])]


def _summed(partial: DataFrame) -> dict[int, np.ndarray]:
    """Rows (i, v) added up per i, as a stream in each task; one row per i reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v")):
                total[i] = total.get(i, 0) + v.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                names=["i", "v"])

    return {r["i"]: np.array(r["v"]) for r in partial.repartition("i").mapInArrow(add, partial.schema).collect()}


def _sums_of(fit: DataFrame, dim: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """What ``rows_of`` gives for the vectors of a batch, a matrix, added up over all batches."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = rows_of(_matrix(batch.column("x"), dim).astype(float))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return _summed(fit.mapInArrow(partial, "i int, v array<double>"))


class Whitening(NamedTuple):
    """A fit: vectors, their sum, their mean, one column per component over the root of its variance."""

    n: int
    total: list[int]
    mean: np.ndarray
    weights: np.ndarray
    explained: list[float]
    identity_error: float


def scaled(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns ``id`` and ``x``: the whole part below of 256 times each entry, as longs.

    Rows are dropped whose vector is NULL, empty, or has an entry that is NULL, not finite or
    too large for a long.
    """
    vector = col(vector_col).cast("array<double>")
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c * SCALE) < float(2**63), F.lit(False)) & ~F.isnan(c))
    return df.where(fits & (F.size(vector) > 0)).select(
        col(id_col).alias("id"), F.transform(vector, lambda c: F.floor(c * SCALE)).alias("x"))


def fit(rows: DataFrame, most: int = 4) -> Whitening | None:
    """Learn from the distinct vectors ``x`` of ``rows``; None when there are none or they do not differ.

    Equal vectors count once, however often they occur; they meet on their whole value after a
    map-side pass has removed repeats. Vectors of another length than the commonest (of
    equally common ones the longest) are left out. Components whose variance is zero up to
    rounding cannot be scaled to one and are left out, so there may be fewer than ``most``.
    """
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0]["dim"]
    distinct = materialize(rows.where(F.size("x") == dim).select("x").distinct(), "vectors")
    n, total = _row_sums(distinct, dim)
    mean = np.array([float(Fraction(s, n)) for s in total])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    summed = _sums_of(distinct, dim, products)
    covariance = np.array([summed[i] for i in range(dim)]) / n
    values, vectors = components(covariance)
    trace = float(np.trace(covariance))
    keep = int((values[:most] > dim * np.finfo(float).eps * values[0]).sum())
    if not keep or trace <= 0:
        return None
    weights = vectors[:, :keep] / np.sqrt(values[:keep])
    own = _sums_of(distinct, dim, lambda x: ((x - mean) @ weights).sum(axis=0, keepdims=True))[0] / n

    def white_products(x: np.ndarray) -> np.ndarray:
        centred = (x - mean) @ weights - own
        return centred.T @ centred

    white = _sums_of(distinct, dim, white_products)
    error = np.abs(np.array([white[i] for i in range(keep)]) / n - np.eye(keep)).max()
    return Whitening(n, total, mean, weights, [float(v) / trace for v in values[:keep]], float(error))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Each row's vector whitened by a broadcast model: id, x, whitened array<double>, deviation long.

    ``deviation`` is the exact sum over dimensions of (n * x - total)^2, NULL where no long
    holds it. Rows whose length is not the model's are left out. One scan, no shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    dim, id_type = len(model.mean), rows.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in fitted.total], np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            centred = x - fitted.mean
            white = centred @ fitted.weights
            rough = (centred * centred).sum(axis=1) * float(fitted.n) ** 2
            with np.errstate(over="ignore"):  # wrong only where ``rough`` is too large, and done again there
                deviation = [int(v) for v in ((x * np.int64(fitted.n) - wrapped) ** 2).sum(axis=1)]
            for row in np.flatnonzero(rough > 4e18):
                exact = sum((fitted.n * int(v) - s) ** 2 for v, s in zip(x[row], fitted.total))
                deviation[row] = exact if exact <= LONGEST else None
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
                 pa.array(deviation, pa.int64())], names=["id", "x", "whitened", "deviation"])

    return rows.where(F.size("x") == dim).mapInArrow(
        apply, f"id {id_type}, x array<bigint>, whitened array<double>, deviation long")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """One row per kept vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Repeated rows and rows without an id are whitened like others, and each gives its rows; a
    table without any vector, or whose vectors do not differ, gives none. Other columns are not read.
    """
    rows = scaled(df, id_col, vector_col)
    model = fit(rows, most)
    id_type = rows.schema["id"].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], (
            f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double"))
    shares = F.array(*[F.lit(v) for v in model.explained])
    return transform(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
