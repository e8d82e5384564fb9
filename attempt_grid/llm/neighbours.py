"""Nearest neighbours by vantage-point trees, one tree per shard of rows.

A tree splits its points by their distance to a vantage point at the median. A query leaves out
the inner (outer) part if the triangle inequality puts all of it farther than the query's k-th
best so far; that bound is multiplied by ``factor``: at 1 the search is exact, above it prunes
more and may miss some. Shards hold about ``shard_rows`` rows. A shard's points come first in its
task, then all queries stream through the one tree in blocks, so a point is shipped once and a
task holds one tree and one block; each gives k rows per query, of which k are kept in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions
from .vectors import blocks, matrix, usable

LEAF = 48


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from the differences themselves, summed in the order of components."""
    out = np.zeros((len(queries), len(points)))
    if 2 * len(queries) < queries.shape[1]:
        for i, q in enumerate(queries):
            out[i] = np.cumsum((points - q) ** 2, axis=1)[:, -1]
    else:
        for q, p in zip(queries.T, points.T):
            out += (q[:, None] - p) ** 2
    return np.sqrt(out)


class VantageTree:
    """nodes: (vantage row, radius, inner, outer) or (rows of a leaf,)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids, self.nodes = points, ids, []
        todo = [(np.arange(len(ids)), None, 0)]
        draw = np.random.default_rng(3)
        while todo:
            rows, parent, side = todo.pop()
            number = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = number
            if len(rows) <= LEAF:
                self.nodes.append([rows])
                continue
            at = rows[draw.integers(len(rows))]
            away = distances(points[at : at + 1], points[rows])[0]
            radius = float(np.median(away))
            inner = away <= radius
            if inner.all():  # mostly one place: halve, and let the radius bound both parts
                inner = np.arange(len(rows)) % 2 == 0
                self.nodes.append([at, np.inf, None, None])
            else:
                self.nodes.append([at, radius, None, None])
            todo += [(rows[inner], number, 2), (rows[~inner], number, 3)]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        """(ids, distances) of the k nearest of each query but itself; missing ones have id -1.
        Ties go to the smaller id."""
        n = len(queries)
        best, found = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            number, active, bound = todo.pop()
            keep = bound * factor <= best[active, -1] * (1 + 1e-12)
            active = active[keep]
            if not len(active):
                continue
            node = self.nodes[number]
            if len(node) == 1:
                rows = node[0]
                away = distances(queries[active], self.points[rows])
                away[self.ids[rows][None, :] == query_ids[active][:, None]] = np.inf
                both = np.concatenate([best[active], away], axis=1)
                names = np.concatenate([found[active], np.broadcast_to(self.ids[rows], away.shape)], axis=1)
                order = np.lexsort((names, both), axis=1)[:, :k]
                best[active], found[active] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
                continue
            vantage, radius, inner, outer = node
            if radius == np.inf:
                todo += [(outer, active, bound[keep]), (inner, active, bound[keep])]
                continue
            away = distances(self.points[vantage : vantage + 1], queries[active])[0]
            inside, outside = np.maximum(bound[keep], away - radius), np.maximum(bound[keep], radius - away)
            near = away <= radius
            # each query takes its own side first; the other side waits below it on the stack
            todo += [(outer, active[near], outside[near]), (inner, active[~near], inside[~near])]
            todo += [(inner, active[near], inside[near]), (outer, active[~near], outside[~near])]
        return np.where(np.isinf(best), -1, found), best


def nearest(
    table: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, shard_rows: int = 4096, query_rows: int = 1024
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of each query, itself left out.

    table has vec_id and embedding. Rows whose id is null, or whose vector is null, empty, zero or
    holds null or non-finite components, take no part; vectors of different lengths are not
    compared. Fewer than k candidates give fewer rows. Ties in distance go to the smaller vec_id.
    """
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")
    ).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    shards = rows.count() // shard_rows + 1
    size = F.size("embedding").alias("size")
    own = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    points = rows.select("vec_id", "embedding", size, own.alias("shard"), F.lit(False).alias("asks"))
    queries = rows.filter("asks").select("vec_id", "embedding", size, all_shards, F.lit(True).alias("asks"))
    make = VantageTree

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held = None, None, []
        for batch in blocks(batches, query_rows):
            sizes, places = (batch.column(c).to_numpy() for c in ("size", "shard"))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy()
            starts = np.flatnonzero(np.r_[True, (sizes[1:] != sizes[:-1]) | (places[1:] != places[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(starts, np.r_[starts[1:], len(ids)]):
                if key != (sizes[a], places[a]):
                    key, tree, held = (sizes[a], places[a]), None, []
                vectors = matrix(batch.column("embedding").slice(a, b - a))
                if not asks[a]:
                    held.append((vectors, ids[a:b]))
                    continue
                if tree is None:
                    if not held:  # a shard without points of this length
                        continue
                    tree, held = make(*map(np.concatenate, zip(*held))), []
                found, away = tree.search(vectors, ids[a:b], k, factor)
                real = ~np.isinf(away)
                yield pa.record_batch(
                    [pa.array(np.repeat(ids[a:b], k)[real.ravel()]), pa.array(found[real]), pa.array(away[real])],
                    ["query_id", "vec_id", "score"],
                )

    # as many partitions as shards, up to a few for each shuffle partition
    met = points.unionAll(queries).repartition(min(shards, 4 * partitions(table.sparkSession)), "size", "shard")
    found = met.sortWithinPartitions("size", "shard", "asks").mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
