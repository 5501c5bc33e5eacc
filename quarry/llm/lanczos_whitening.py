"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows, two sequences of unit vectors are built: X v_k = beta u_(k-1) +
alpha u_k and Xᵀ u_k = alpha v_k + beta v_(k+1). Every step is one pass of Spark over the
stored rows, which multiplies them with one vector, and the outcome with the rows again:
the products X p and Xᵀ (X p) of a partition are sums of its rows, added up before they are
sent. The alphas and betas are a small bidiagonal matrix; its singular values and right
singular vectors, carried back by the v's, are those of X.

All vectors are orthogonalised against all before them, twice. For the v's the driver does
it. A left vector u has an entry per row and is never stored: u_k = X y_k for a short y_k that
the driver holds, so X p stands orthogonal to all u's once p is corrected by the y's. The
coefficients are (Xᵀ u_j)·p, known from earlier steps, and are taken once more from inner
products measured in the pass itself.

The steps end when the wanted singular triplets have settled to rounding in the first half of
the space, or the v's span it. A start vector can miss a further direction of a repeated singular value. So if the v's
don't span the space, a second run from a new start, orthogonal to what was found, must find
nothing larger; what it finds is taken in, and another run follows.

Entries c become whole numbers x = floor(scale c) + shift, so that sums, means and deviations are
exact. ``deviation`` is computed modulo 2**64, which is exact when it fits a bigint; it is null
where it doesn't.

Defined results: rows whose vector is null, empty, holds a null or non-finite entry or one
beyond 2**40, or isn't of the most frequent length (ties: the longest) take no part and give
no rows. Rows that repeat an id, and rows with a null id, each count. Components without
variance (singular values at rounding level) can't be whitened and are left out; so a table
of equal rows gives no rows, nor does an empty one. Extra columns are ignored.

To the driver come, per pass, as many sums as a vector has entries and steps were made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stored, table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
LARGEST = float(2**40)
#: of the largest singular value: what counts as nothing, and as settled
NOTHING, SETTLED = 1e-13, 1e-17


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the rows that take part, stored."""
    v = F.col("v")
    plain = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    sound = plain.where(v.isNotNull() & (F.size(v) > 0) & fit)
    length = sound.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), F.desc("n")).first()
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("bigint"))
    return stored(sound.where(F.size(v) == (length.n if length else 0)).select("id", x.alias("x")), "whole-vectors")


def _matrix(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.int64).reshape(-1, dim)


def _summed(rows: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray], kind: str) -> np.ndarray:
    """The sum of ``work`` over all batches: each task adds up its own, Spark adds by place."""
    dtype = np.int64 if kind == "bigint" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = work(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.from_numpy_dtype(dtype)))], ["sums"])

    sums = rows.mapInArrow(run, f"sums array<{kind}>").select(F.posexplode("sums").alias("place", "value"))
    places = sums.groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(places)], dtype)


@dataclass
class Moments:
    """Exact count and sums (Python integers), and what centres a block of rows."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part is taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of (n x - S)² modulo 2**64 as bigint, whether it fits)."""
        wrapped = np.array([s % 2**64 for s in self.sums], np.uint64)
        far = x.view(np.uint64) * np.uint64(self.n) - wrapped
        about = np.square(self.centred(x) * self.n).sum(axis=1)
        return (far * far).sum(axis=1, dtype=np.uint64).view(np.int64), about < 2.0**63 * (1 - 1e-9)


def moments(vectors: DataFrame, dim: int) -> Moments:
    """n and S, from sums of high and low halves that can't overflow."""

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, 0, dim)
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    got = [int(v) for v in _summed(vectors.select("x"), halves, "bigint")]
    return Moments(got[0], [(hi << 32) + lo for hi, lo in zip(got[1 : dim + 1], got[dim + 1 :], strict=True)])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        if basis:
            b = np.array(basis)
            v = v - b.T @ (b @ v)
    return v


@dataclass
class Steps:
    """A bidiagonalisation: the v's, the matrix's diagonal and what stands beside it."""

    v: list[np.ndarray]
    alpha: list[float]
    beta: list[float]

    def triplets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(singular values, vectors as rows, residual norms)."""
        matrix = np.diag(self.alpha) + np.diag(self.beta[: len(self.alpha) - 1], 1)
        left, values, right = np.linalg.svd(matrix)
        return values, right @ np.array(self.v), np.abs(self.beta[-1] * left[-1])


def bidiagonalise(products: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], dim: int, wanted: int,
                  seed: int, locked: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, bool]:
    """(singular values, right singular vectors, whether the v's span the space) of the operator
    on what is orthogonal to the rows of ``locked``.

    ``products(p, Y)`` gives |X p|², Xᵀ X p and (X Y)ᵀ X p. The run also ends when its
    largest value has settled below ``floor``."""
    rng = np.random.default_rng(seed)
    fixed, room = list(locked), dim - len(locked)
    steps = Steps([], [], [])
    ys: list[np.ndarray] = []  # u_j = X y_j; zero for a v that X takes to nothing
    zs: list[np.ndarray] = []  # Xᵀ u_j
    largest, ahead = 0.0, None
    while True:
        if ahead is None:  # a start, or nothing was left of the last direction
            ahead = _orthogonal(rng.standard_normal(dim), fixed + steps.v)
            ahead /= np.linalg.norm(ahead)
        steps.v.append(ahead)
        p, y = ahead, np.array(ys).reshape(len(ys), dim).T
        if ys:
            p = p - y @ (np.array(zs) @ p)
        square, z, against = products(p, y)
        if ys:  # what the measured inner products say is left of the earlier u's
            p, z, square = p - y @ against, z - np.array(zs).T @ against, square - against @ against
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        if alpha <= NOTHING * largest or alpha == 0.0:
            alpha, p, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            p, z = p / alpha, z / alpha
        steps.alpha.append(alpha)
        ys.append(p)
        zs.append(z)
        rest = _orthogonal(z, fixed + steps.v)
        beta = float(np.linalg.norm(rest))
        largest = max(largest, beta)
        ended = beta <= NOTHING * largest
        steps.beta.append(0.0 if ended else beta)
        ahead = None if ended else rest / beta
        values, vectors, residual = steps.triplets()
        spanned = len(steps.v) == room
        if spanned:
            return values[:wanted], vectors[:wanted], True
        settled = residual <= SETTLED * max(values[0], floor)
        early = len(locked) > 0 or 2 * len(steps.v) <= room  # later, spanning the space is cheaper than another run
        if early and not ended and len(values) >= wanted and (settled[:wanted].all() or (settled[0] and values[0] < floor)):
            return values[:wanted], vectors[:wanted], False


@dataclass
class Whitening:
    """What :func:`fit` learns: moments, unit components as rows, eigenvalues, share of the trace."""

    moments: Moments
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """Components of the rows of :func:`whole_vectors`."""
    rows, m = vectors.select("x"), moments(vectors, dim)

    def products(p: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(batch: pa.RecordBatch) -> np.ndarray:
            x = m.centred(_matrix(batch, 0, dim))
            w = x @ p
            z = x.T @ w
            return np.concatenate([[w @ w], z, (x @ y).T @ w])

        got = _summed(rows, work, "double")
        return float(got[0]), got[1 : dim + 1], got[dim + 1 :]

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([np.square(m.centred(_matrix(batch, 0, dim))).sum()])

    trace = float(_summed(rows, spread, "double")[0]) / m.n
    wanted = min(components, dim)
    values, vectors_, whole = bidiagonalise(products, dim, wanted, 1, np.zeros((0, dim)))
    seed = 2
    while not whole and values[0] > 0:
        more, directions, _ = bidiagonalise(products, dim, 1, seed, vectors_, floor=float(values[-1]))
        seed += 1
        if more[0] <= values[-1] * (1 + 1e-12):
            break
        both, all_ = np.append(values, more[0]), np.vstack([vectors_, directions])
        order = np.argsort(-both, kind="stable")[:wanted]
        values, vectors_ = both[order], all_[order]
    real = values > NOTHING * np.sqrt(m.n) * max(values[0], 1.0)
    eigenvalues = values[real] ** 2 / m.n
    unit = vectors_[real] / np.linalg.norm(vectors_[real], axis=1, keepdims=True)
    return Whitening(m, unit, eigenvalues, eigenvalues / trace if trace else eigenvalues)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over all rows."""
    k, dim, n = len(model.components), model.components.shape[1], model.moments.n
    rows = vectors.select("x")
    mean = _summed(rows, lambda b: model.apply(_matrix(b, 0, dim)).sum(axis=0), "double") / n

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        w = model.apply(_matrix(batch, 0, dim)) - mean
        return (w.T @ w).ravel()

    return float(np.abs(_summed(rows, centred, "double").reshape(k, k) / n - np.eye(k)).max())


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per row that takes part and component, numbered from 1 by falling variance: vec_id,
    component, n, deviation, whitened, explained, identity_error."""
    vectors = whole_vectors(rows, id_col, vector_col)
    kind = vectors.schema["id"].dataType.simpleString()
    head = vectors.select(F.size("x").alias("n")).first()
    if head is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    dim = head.n
    model = fit(vectors, dim, components)
    k, n = len(model.components), model.moments.n
    error = identity_error(vectors, model) if k else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1, dim)
            far, fits = model.moments.deviations(x)
            every = len(x) * k
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(every, n)),
                pa.array(np.repeat(far, k), mask=np.repeat(~fits, k)),
                pa.array(model.apply(x).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(every, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    return vectors.mapInArrow(work, f"vec_id {kind}, {SCHEMA}")


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
