"""Near copies among embeddings by product quantisation with guaranteed probes.

Unit vectors are filed in coarse inverted lists (nearest centroid); their residuals are kept as
one code per subspace, and the error of that code is stored with each. Cosine >= t means a
distance of at most r = sqrt(2 - 2t) between unit vectors. A vector probes every list whose cell
may hold a point within r, by the distance to the plane between the two centroids; a pair in
two lists is looked for once, by the vector of the smaller list. In a probed list, table lookups
give the distance to a member's reconstruction, which exceeds the true distance by at most the
member's stored error: members beyond r plus that error are dropped, the rest are reranked by
the exact cosine. Codebooks come from a bounded sample, yet no link is lost by them.

Equal vectors of one label are a class with one representative. Crowded lists are split into
tiles, and a tile returns link counts and a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tiled, written
from .components import connected_components
from .vectors import blocks, kmeans, matrix, nearest_rows, sample_matrix, scaled, usable

ROUNDING = 1e-6


class Quantiser:
    """Coarse centroids and one codebook of residuals per subspace."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        self.centroids = kmeans(sample, lists)
        c = self.centroids
        self.apart = np.stack([np.sqrt(np.maximum(((c - x) ** 2).sum(axis=1), 1e-30)) for x in c])
        residuals = sample - c[nearest_rows(sample, c)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(residuals[:, p], codes) for p in self.parts]

    def encode(self, units: np.ndarray):
        """(list, codes, error of the reconstruction) of each vector."""
        own = nearest_rows(units, self.centroids)
        residuals = units - self.centroids[own]
        codes = np.stack([nearest_rows(residuals[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        error = sum(((residuals[:, p] - b[codes[:, i]]) ** 2).sum(axis=1) for i, (p, b) in enumerate(zip(self.parts, self.books)))
        return own, codes.astype(np.uint8), np.sqrt(error)

    def probes(self, units: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which other lists may hold a point within radius: (vector, list) booleans."""
        c = self.centroids
        squares = (units**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * units @ c.T
        apart = self.apart[own]
        bound = (squares - squares[np.arange(len(own)), own][:, None]) / (2 * apart)
        near = bound <= radius + ROUNDING
        near[np.arange(len(own)), own] = False
        return near

    def tables(self, units: np.ndarray, coarse: int) -> list[np.ndarray]:
        """Squared distances of each vector's residual to all codes, by subspace."""
        residuals = units - self.centroids[coarse]
        return [((residuals[:, p][:, None, :] - b) ** 2).sum(axis=2) for p, b in zip(self.parts, self.books)]


def _filed(quantiser: Quantiser, radius: float):
    """Home and visiting rows of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1024):
            vectors = scaled(matrix(batch.column("embedding")))
            units = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
            own, codes, error = quantiser.encode(units)
            near = quantiser.probes(units, own, radius) & (np.arange(len(quantiser.centroids)) > own[:, None])
            row, coarse = np.nonzero(near)
            rows = np.concatenate([np.arange(len(own)), row])
            taken = batch.take(pa.array(rows))
            home = np.arange(len(rows)) < len(own)
            yield pa.record_batch(
                [pa.array(np.concatenate([own, coarse]).astype(np.int32)), pa.array(home), taken.column("label"), taken.column("rep"),
                 taken.column("n"), taken.column("embedding"),
                 pa.array([codes[i].tobytes() for i in rows]), pa.array(error[rows])],
                ["coarse", "home", "label", "rep", "n", "embedding", "code", "error"],
            )

    return run


def _forest(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the bipartite graph of (query, target) booleans."""
    label = np.arange(links.shape[0])
    for t in np.flatnonzero(links.any(axis=0)):
        near = np.flatnonzero(links[:, t])
        names, first = np.unique(label[near], return_index=True)
        for q in near[first]:
            yield q, t
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]


def _compare(quantiser: Quantiser, least: float, radius: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, targets = None, None
        for batch in blocks(batches, 512):
            cell, tile = (batch.column(c).to_numpy() for c in ("cell", "tile"))
            target, query, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("target", "query", "home"))
            rep, n, coarse = (batch.column(c).to_numpy() for c in ("rep", "n", "coarse"))
            error = batch.column("error").to_numpy()
            vectors, codes = scaled(matrix(batch.column("embedding"))), np.stack([np.frombuffer(c, np.uint8) for c in batch.column("code").to_pylist()])
            norms = np.sqrt((vectors**2).sum(axis=1))
            units = vectors / norms[:, None]
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])])
            counts: dict[int, int] = {}
            links: list[tuple] = []
            for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
                if key != (cell[a], tile[a]):
                    key, targets = (cell[a], tile[a]), None
                rows = np.arange(a, b)
                new = rows[target[rows]]
                mine = (rep[new], n[new], vectors[new], norms[new], codes[new], error[new])
                before = 0 if targets is None else len(targets[0])
                targets = mine if targets is None else tuple(np.concatenate(x) for x in zip(targets, mine))
                asking = rows[query[rows]]
                if not len(targets[0]) or not len(asking):
                    continue
                t_rep, t_n, t_vec, t_norm, t_code, t_error = targets
                tables = quantiser.tables(units[asking], int(coarse[asking[0]]))
                rough = sum(t[:, t_code[:, i]] for i, t in enumerate(tables))
                near = np.sqrt(np.maximum(rough, 0)) <= radius + t_error + ROUNDING
                # at home each pair once: a row that is target and query meets those before it; where
                # a tile has the two apart (all targets first), the query has the larger id
                place = before + np.cumsum(target[rows])[query[rows]] - 1
                once = np.where(target[asking][:, None], np.arange(len(t_rep)) < place[:, None], rep[asking][:, None] > t_rep)
                near &= once | ~home[asking][:, None]
                q, t = np.nonzero(near)
                exact = np.einsum("ij,ij->i", vectors[asking[q]], t_vec[t]) / (norms[asking[q]] * t_norm[t])
                linked = exact >= least
                if not linked.any():
                    continue
                dense = np.zeros((len(asking), len(t_rep)), bool)
                dense[q[linked], t[linked]] = True
                for who, others in ((rep[asking], dense @ t_n), (t_rep, n[asking] @ dense)):
                    for i in np.flatnonzero(others).tolist():
                        counts[int(who[i])] = counts.get(int(who[i]), 0) + int(others[i])
                links += [(int(rep[asking[i]]), int(t_rep[j]), 0) for i, j in _forest(dense)]
            out = links + [(x, None, k) for x, k in counts.items()]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])

    return run


def embedding_components(
    table: DataFrame, least_cosine: float = 0.93, sample_rows: int = 20_000, subspaces: int = 16, codes: int = 256, lists: int | None = None,
    tile_rows: int = 2048,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and their lengths are equal.
    Null, zero and non-finite vectors link with nothing and are components of their own, as are
    vectors without a label. The quantiser is fitted on at most sample_rows vectors (those with
    the smallest hashes); every vector is filed. The number of lists grows with the square root of
    that of vectors (256 at most), as each vector may have to probe a share of them. A vec_id should be unique; rows that repeat one
    with the same vector count as copies.
    """
    if codes > 256:
        raise ValueError("a code is one byte: at most 256 codes a subspace")
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    rows = rows.withColumn("usable", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    alone = rows.filter("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    rows = rows.filter("usable").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("label").alias("label"))
    classes = written(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    n_classes = classes.count()
    found = None
    for (size,) in classes.select(F.size("embedding")).distinct().collect():
        same = classes.filter(F.size("embedding") == size)
        sample = scaled(sample_matrix(same, "embedding", sample_rows, F.xxhash64("embedding")))
        sample = sample / np.sqrt((sample**2).sum(axis=1))[:, None]
        radius = math.sqrt(max(0.0, 2 - 2 * least_cosine))
        quantiser = Quantiser(sample, lists or min(256, math.isqrt(n_classes) // 8 + 1), subspaces, codes)
        filed = same.mapInArrow(
            _filed(quantiser, radius),
            "coarse int, home boolean, label long, rep long, n long, embedding array<double>, code binary, error double",
        )
        cells = written(filed.withColumn("cell", F.xxhash64("label", "coarse")))
        met = (
            tiled(cells, "rep", tile_rows)
            .repartition(partitions(spark), "cell", "tile")
            .sortWithinPartitions("cell", "tile", F.col("target").desc())
            .mapInArrow(_compare(quantiser, least_cosine, radius), "a long, b long, n long")
        )
        found = met if found is None else found.unionAll(met)
    if found is None:
        return alone
    found = written(found)
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    known = classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = rows.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionAll(alone)
