"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The matrix X (one centred row for each distinct vector) stays in its table. A step
multiplies a few directions from the right (X v) and what comes out from the left (X' u),
both in one pass over the rows, and takes away what the directions so far explain: full
reorthogonalisation on both sides. Left vectors are never stored: each lies in the range of
X, so it is kept as its small coefficient vector c (u = X c) and computed again from the row
in each pass. What the driver holds has the size of the dimension, whatever the number of rows.

The steps go in blocks of BLOCK directions, so B is bidiagonal in blocks: a pass serves a
whole block, and an eigenvalue that several directions share is found with all of them,
which a single start vector cannot do. The singular values of the small B give components
and deviations; steps end when the wanted ones are exact to rounding, or the space is used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.frames import landed

COMPONENTS, BLOCK, GRID = 4, 8, 256
#: rounds of sums before the driver: it gets this many partial sums, whatever the number of tasks
MEETING = 8
#: directions shorter than this share of the longest are rounding
NOISE = 1e-8


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with exact ``sums`` per dimension; ``directions`` (dimension x components),
    unit columns by falling eigenvalue of the covariance; ``variance`` per component; the ``trace`` of
    the covariance; ``identity_error``: the largest entry of whitened covariance minus identity."""
    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variance: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))


# --- vectors on the grid ----------------------------------------------------------------

def _usable(vector: Column) -> Column:
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != inf))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def on_grid(vectors: DataFrame, vector: str = "embedding", grid: int = GRID) -> tuple[DataFrame, int]:
    """``vectors`` without the rows whose vector is NULL or holds a NULL or non-finite entry, with
    ``x``: floor(grid * entry) as longs. Shorter vectors count as followed by zeros; returns the dimension too."""
    good = vectors.filter(_usable(F.col(vector)))
    least, most = good.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    dim = int(most or 0)
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(grid))).cast("long"))
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(vector)))
    return good.withColumn("x", x), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _totals(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums per dimension."""
    def run(batches: Iterator[pa.RecordBatch]):
        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            # two halves of 32 bits, so that no sum of a batch overflows
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()),
                                              pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], names=["at", "v"])

    got = {r["at"]: int(r["v"]) for r in fit.mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    return got.get(-1, 0), tuple(got.get(j, 0) for j in range(dim))


# --- products with the distributed rows -------------------------------------------------

def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int, dim: int) -> np.ndarray:
    """Sum over all rows of what ``partial`` makes of a batch of them: one vector a task, added up by
    MEETING tasks before the driver gets it."""
    def tasks(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(_matrix(batch.column(0), dim))
        yield _one(total)

    def meet(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += _matrix(batch.column(0), size).sum(axis=0)
        yield _one(total)

    met = rows.mapInArrow(tasks, "v array<double>").repartition(MEETING).mapInArrow(meet, "v array<double>").collect()
    return np.sum([r["v"] for r in met], axis=0) if met else np.zeros(size)


def _one(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])


def _products(fit: DataFrame, mean: np.ndarray, known: np.ndarray, new: np.ndarray):
    """For U = X known and P = X new: U'P, P'P, X'P, the column sums of P, and the sum of all squares of X."""
    d, m, b = len(mean), known.shape[1], new.shape[1]

    def partial(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        p = centred @ new
        return np.concatenate([((centred @ known).T @ p).ravel(), (p.T @ p).ravel(), (centred.T @ p).ravel(),
                               p.sum(axis=0), [np.einsum("ij,ij->", centred, centred)]])

    cuts = np.cumsum([m * b, b * b, d * b, b])
    up, pp, xp, ones, square = np.split(_summed(fit, partial, int(cuts[-1]) + 1, d), cuts)
    return up.reshape(m, b), pp.reshape(b, b), xp.reshape(d, b), ones, float(square[0])


def _orthonormal(columns: np.ndarray, against: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(q, r): what the columns hold beyond ``against`` is q r, q orthonormal; directions below ``least`` are left out."""
    rest = columns
    for _ in range(2):
        rest = rest - against @ (against.T @ rest)
    q, s, _ = np.linalg.svd(rest, full_matrices=False)
    q = q[:, s > least]
    for _ in range(2):      # near-null columns need it once more
        q = np.linalg.qr(q - against @ (against.T @ q))[0] if q.shape[1] else q
    return q, q.T @ columns


def _left(fit: DataFrame, mean: np.ndarray, known: np.ndarray, right: np.ndarray, longest: float):
    """New left directions from X right, orthonormal to the known ones: (coefficients, X' times the columns they
    were made of, the known part of those columns, X right in the known ones, in the new ones, longest singular
    value met so far)."""
    c, into = right, np.eye(right.shape[1])
    inside = np.zeros((known.shape[1], right.shape[1]))
    up, pp, xp, _, _ = _products(fit, mean, known, c)
    longest = max(longest, float(np.sqrt(max(np.linalg.eigvalsh(pp).max(), 0.0))))
    least, off = (NOISE * longest) ** 2, np.inf         # the first Gram matrix is in units of X
    while True:
        inside += up @ into
        gram = pp - up.T @ up
        value, turn = np.linalg.eigh((gram + gram.T) / 2)
        keep = value > least
        value, turn = value[keep], turn[:, keep]
        scale = turn / np.sqrt(value)
        c, xu, beyond = (c - known @ up) @ scale, xp @ scale, up @ scale
        into = (turn * np.sqrt(value)).T @ into
        if off < 1e-7 or not c.shape[1]:
            return c, xu, beyond, inside, into, longest
        # measured again: what is left over is taken away until it is rounding
        up, pp, xp, _, _ = _products(fit, mean, known, c)
        off = max(np.abs(up).max(initial=0.0), np.abs(pp - np.eye(len(pp))).max())
        least = 0.25


def _bidiagonalise(fit: DataFrame, mean: np.ndarray, wanted: int, block: int):
    """(right directions, their lengths, sum of squares of X): the leading singular triplets of X."""
    d = len(mean)
    rng = np.random.Generator(np.random.PCG64(11))
    right, left, xu = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    small = np.zeros((0, 0))
    longest, square, restarted = 0.0, _products(fit, mean, left, np.zeros((d, 1)))[4], False
    new = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    while True:
        c, x_new, beyond, inside, own, longest = _left(fit, mean, left, new, longest)
        if restarted and not c.shape[1]:
            break       # nothing varies outside of the space found
        x_new = x_new - xu @ beyond
        small = np.block([[small, inside], [np.zeros((c.shape[1], small.shape[1])), own]])
        right, left, xu = np.hstack([right, new]), np.hstack([left, c]), np.hstack([xu, x_new])
        p, length, q = np.linalg.svd(small, full_matrices=False)
        new, couple = _orthonormal(x_new, right, 1e-14 * max(longest, 1e-300) * np.sqrt(d)) if c.shape[1] else (np.zeros((d, 0)), None)
        top = min(wanted, len(length))
        if new.shape[1] and top == wanted:
            rest = np.linalg.norm(couple @ p[-c.shape[1]:, :top], axis=0)
            if (rest <= 1e-14 * length[0]).all():
                break
        restarted = not new.shape[1] and right.shape[1] < d
        if restarted:
            # an invariant space: go on outside of it, where lengths may tie with those inside
            new, _ = _orthonormal(rng.standard_normal((d, min(block, d - right.shape[1]))), right, 1e-6)
        if not new.shape[1] or right.shape[1] >= d:
            break
    return right @ q.T, length, square


def fit_whitening(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK,
                  grid: int = GRID) -> Whitening:
    """Learn the whitening from every distinct vector (see :func:`on_grid`), each counted once.

    Directions along which nothing varies are no components, so there may be fewer than ``components``;
    with fewer than two distinct vectors there are none."""
    good, dim = on_grid(vectors, vector, grid)
    if not dim:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    fit = landed(good.select("x").distinct())
    n, sums = _totals(fit, dim)
    mean = np.array([s / n for s in sums])
    y, length, square = _bidiagonalise(fit, mean, components, block)
    keep = np.flatnonzero(length > NOISE * max(length.max(initial=0.0), 1e-300))[:components]
    y, variance = y[:, keep] / np.linalg.norm(y[:, keep], axis=0), length[keep] ** 2 / n
    error = 0.0
    if len(keep):
        _, pp, _, ones, _ = _products(fit, mean, np.zeros((dim, 0)), y / np.sqrt(variance))
        error = float(np.abs(pp / n - np.outer(ones, ones) / n / n - np.eye(len(keep))).max())
    return Whitening(n, sums, y, variance, square / n, error)


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact at any size; NULL beyond 38 digits."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max((abs(s) for s in sums), default=0)
    kind = np.int64 if most * most * max(1, len(sums)) < 1 << 62 else object
    away = n * x.astype(kind) - np.array(sums, dtype=kind)
    total = (away * away).sum(axis=1)
    if kind is np.int64:
        return pa.array(total).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in total], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding", grid: int = GRID) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row of ``vectors``
    with a usable vector and each component of ``model``.

    ``deviation`` is exact, NULL beyond 38 digits. Repeated rows and NULL keys give rows of their own; other
    columns are ignored; an empty table, or one without variation, gives an empty table. A vector longer
    than the fitted ones loses what is beyond."""
    n, sums, dim = model.n, model.sums, len(model.sums)
    good = vectors.filter(_usable(F.col(vector)))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * F.lit(float(grid))).cast("long"))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(dim) - F.size(vector)))
    x = F.when(F.size(vector) == dim, x).otherwise(F.slice(F.concat(x, zeros), 1, max(dim, 1)))
    kind = dict(vectors.dtypes)[key]
    schema = (f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    mean, turn = model.mean, model.directions / np.sqrt(model.variance) if len(model.variance) else np.zeros((dim, 0))
    explained, error, r = model.variance / model.trace if len(model.variance) else np.zeros(0), model.identity_error, len(model.variance)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches if r else ():
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1), dim)
            exact = _deviation(m, n, sums)
            row = np.repeat(np.arange(len(m)), r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), len(m))),
                 pa.array(np.full(len(row), n)), exact.take(pa.array(row)), pa.array(((m - mean) @ turn).ravel()),
                 pa.array(np.tile(explained, len(m))), pa.array(np.full(len(row), error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.select(F.col(f"`{key}`"), x.alias("x")).mapInArrow(run, schema)
