"""Vector columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a double matrix."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors by powers of two, so that the largest component lies in [0.5, 1): no square of it
    is lost or infinite, and cosines keep every bit."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -power[:, None])


def sample_matrix(vectors: DataFrame, column: str, most: int, order: Column) -> np.ndarray:
    """At most ``most`` vectors, those first by order, on the driver."""
    rows = vectors.orderBy(order).limit(most).select(column).toArrow()
    return matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds; fewer than k where there are fewer different points."""
    different = np.unique(points, axis=0)
    k = max(1, min(k, len(different)))
    centroids = different[np.random.default_rng(seed).choice(len(different), k, replace=False)]
    for _ in range(rounds):
        nearest = nearest_rows(points, centroids)
        counts = np.bincount(nearest, minlength=k)
        sums = np.stack([np.bincount(nearest, points[:, d], k) for d in range(points.shape[1])], axis=1)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_rows(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    size = (centroids**2).sum(axis=1)
    return np.concatenate(
        [np.zeros(0, np.int64)]
        + [(size - 2 * points[a : a + 8192] @ centroids.T).argmin(axis=1) for a in range(0, len(points), 8192)]
    )


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
