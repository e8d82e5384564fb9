"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers, so sums and deviations are exact; a row is centred as (n*x - S) / n,
where only the division rounds. The covariance matrix is never formed. What the tables are read
for is its product with a narrow block Q, one pass each: tasks return Xᵀ(XQ) of their rows, which
Spark adds up by dimension.

A few Lanczos passes bound the spectrum from below. Each round then sends the block through the
Chebyshev polynomial of the unwanted interval, by the three-term recurrence, one pass a degree:
on the interval it stays within 1, above it grows like cosh. QR and Rayleigh-Ritz follow, until
the residuals of all wanted pairs are down to rounding. The block is wider than what is wanted, and
is doubled where a round gains too little (many nearly equal eigenvalues), at last to the whole
space, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import blocks

COMPONENTS = 16
DEGREE = 10
LANCZOS_PASSES = 10
SCALE, OFFSET = 64, 1_000_000
# Entries up to here become whole numbers that a long holds.
LARGEST_ENTRY = float(1 << 55)
IDENTITY_TOLERANCE = 1e-4
ROWS = 4096
EPS = np.finfo(np.float64).eps


@dataclass(frozen=True, slots=True)
class Centre:
    """Number and exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: as longs where they fit, else as Python integers."""
        largest = max((abs(s) for s in self.sums), default=0)
        if x.size and (int(np.abs(x).max()) * self.n + largest) >= 1 << 62:
            x = x.astype(object)
        return x * self.n - np.array(self.sums, x.dtype)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)² of each row; None where a long cannot hold it."""
        away = self.deviations(x)
        if away.dtype != object and (not away.size or float(np.abs(away).max()) ** 2 * away.shape[1] < 2.0**62):
            return (away * away).sum(axis=1).tolist()
        totals = ((v := away.astype(object)) * v).sum(axis=1)
        return [t if t < 1 << 63 else None for t in totals.tolist()]


@dataclass(frozen=True, slots=True)
class Whitening:
    """Components as columns of ``axes`` with their variances, of all vectors of one length."""

    centre: Centre
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.axes / np.sqrt(self.variances)


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _summed(fit: DataFrame, size: int, width: int, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of of_rows(x) over blocks of rows: a matrix of ``width`` columns, whose rows Spark adds up.

    A task returns one matrix, so what is shuffled grows with the tasks, not with the rows."""
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in blocks(batches, ROWS):
            part = of_rows(_numbers(batch.column("x"), size))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T.copy())], ["r", *names])

    parts = fit.select("x").mapInArrow(run, ", ".join(["r long", *(f"{c} double" for c in names)]))
    rows = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return np.array([r[1:] for r in sorted(rows)], np.float64)


class _Covariance:
    """Products of the covariance matrix of the fit list with blocks, one pass each."""

    def __init__(self, fit: DataFrame, centre: Centre):
        self.fit, self.centre, self.size = fit, centre, len(centre.sums)
        self.trace = float("nan")

    def times(self, q: np.ndarray) -> np.ndarray:
        centre, shared = self.centre, self.fit.sparkSession.sparkContext.broadcast(q)

        def of_rows(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return np.column_stack([c.T @ (c @ shared.value), (c * c).sum(axis=0)])

        both = _summed(self.fit, self.size, q.shape[1] + 1, of_rows) / centre.n
        shared.unpersist()
        self.trace = float(both[:, -1].sum())
        return both[:, :-1]

    def lower_bound(self, draw: np.random.Generator) -> float:
        """About the smallest eigenvalue, from below: Lanczos' least value less its last residual."""
        basis = [(v := draw.standard_normal(self.size)) / np.linalg.norm(v)]
        diagonal, beside = [], []
        for _ in range(min(self.size, LANCZOS_PASSES)):
            w = self.times(basis[-1][:, None])[:, 0]
            diagonal.append(float(w @ basis[-1]))
            for _ in range(2):  # once more for what rounding left
                w = w - np.array(basis).T @ (np.array(basis) @ w)
            beside.append(float(np.linalg.norm(w)))
            if beside[-1] <= EPS * max(map(abs, diagonal)) * self.size:
                break
            basis.append(w / beside[-1])
        k = len(diagonal)
        small = np.diag(diagonal) + np.diag(beside[: k - 1], 1) + np.diag(beside[: k - 1], -1)
        return max(0.0, float(np.linalg.eigvalsh(small)[0]) - beside[-1])


def _filtered(v: _Covariance, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block after the Chebyshev polynomial that is small on [low, high] and 1 at top.

    vq is the first product, known from Rayleigh-Ritz, so this takes degree - 1 passes."""
    half, middle = max((high - low) / 2, EPS * top), (high + low) / 2
    first = scale = half / max(top - middle, half)
    before, now = q, (vq - middle * q) * (scale / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - scale)
        before, now = now, (v.times(now) - middle * now) * (2 * new / half) - (scale * new) * before
        scale = new
    return now


def leading_components(v: _Covariance, wanted: int, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(axes, eigenvalues), falling, of the covariance matrix, with residuals down to rounding."""
    draw = np.random.default_rng(11)
    width = min(v.size, 3 * wanted)
    q = np.linalg.qr(draw.standard_normal((v.size, width)))[0]
    low, last = None, np.inf
    while True:
        vq = v.times(q)
        inner = q.T @ vq
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = float(values[0])
        if top <= 0:
            return q[:, :0], values[:0]
        worst = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max())
        if worst <= 8 * EPS * np.sqrt(v.size) * top or width == v.size:
            return q[:, :wanted], values[:wanted]
        if worst > last / 10:
            more = draw.standard_normal((v.size, min(v.size, 2 * width) - width))
            width += more.shape[1]
            q, last = np.linalg.qr(np.column_stack([q, more]))[0], np.inf
            continue
        low, last = v.lower_bound(draw) if low is None else low, worst
        high = float(values[-1])
        q = np.linalg.qr(_filtered(v, q, vq, min(low, high), high, top, degree))[0]


def fit_whitening(fit: DataFrame, centre: Centre, components: int = COMPONENTS, degree: int = DEGREE) -> Whitening:
    """The whitening of the different rows ``fit`` (x: longs of one length).

    Components end where whitened rows no longer have unit covariance: directions without
    variance, or with less than double precision can tell from none."""
    v = _Covariance(fit, centre)
    axes, variances = leading_components(v, min(components, v.size), degree)
    keep = variances > EPS * (variances[0] if len(variances) else 1.0)
    axes, variances = axes[:, keep], variances[keep]
    signs = np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)) if axes.size else 1.0
    axes, error = axes * signs, 0.0
    if axes.shape[1]:
        trial = Whitening(centre, axes, variances, variances, 0.0)

        def moments(x: np.ndarray) -> np.ndarray:
            w = trial.apply(x)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = _summed(fit, v.size, axes.shape[1], moments) / centre.n
        unit = np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(axes.shape[1]))
        errors = [unit[:k, :k].max() for k in range(1, len(variances) + 1)]
        k = sum(e <= IDENTITY_TOLERANCE for e in errors)  # they only grow
        axes, variances, error = axes[:, :k], variances[:k], float(errors[k - 1]) if k else 0.0
    return Whitening(centre, axes, variances, variances / v.trace, error)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS, degree: int = DEGREE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    table has vec_id and embedding. Rows whose vector is null, or holds a null, a non-finite
    component or one beyond 2^55 (no long holds its whole number), are left out; a null vec_id
    stays and repeated rows are returned as often as they occur. Every different vector counts
    once in the fit. Vectors of each length are a table of their own. There are as many components
    as have a variance: none for empty vectors or where all vectors are equal. A deviation that no
    long holds is null. Nothing is returned for an empty table.
    """
    entry = lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST_ENTRY)
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = vectors.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine)).select(
        "vec_id", F.size("v").alias("size"), F.transform("v", entry).alias("x")
    )
    fit = written(rows.select("size", "x").distinct())
    at = fit.select("size", F.posexplode("x").alias("dim", "entry"))
    totals: dict[int, dict[int, tuple[int, int]]] = {}
    for r in at.groupBy("size", "dim").agg(F.sum(F.col("entry").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).collect():
        totals.setdefault(r["size"], {})[r["dim"]] = int(r["total"]), r["n"]
    models = {}
    for size, sums in totals.items():
        centre = Centre(sums[0][1], tuple(sums[d][0] for d in range(size)))
        models[size] = fit_whitening(fit.filter(F.col("size") == size), centre, components, degree)
    shared = table.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, ROWS):
            for size in set(batch.column("size").to_pylist()):
                model = shared.value[size]
                some = batch.filter(pa.compute.equal(batch.column("size"), size))
                k, x = len(model.variances), _numbers(some.column("x"), size)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), model.centre.n, np.int64)),
                        pa.array(model.centre.squares(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(len(each), model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, RESULT)
