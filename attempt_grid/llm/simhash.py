"""SimHash near-duplicates: segment popcounts as a grid, verified by exact Hamming distance.

A text's fingerprint has a bit where over half of its shingle hashes have it. To link
fingerprints at ``max_bits`` = 3 or fewer differing bits without comparing all pairs, each
32-bit half is embedded as the popcounts of its sixteen 2-bit segments. The Manhattan distance
of two embeddings never exceeds the Hamming distance, and of 3 differing bits at most one lies
in one of the halves. So it is enough to range-join, half by half, grid cells at Manhattan
distance 0 or 1, and to verify the candidates by their bits.

Copies share a fingerprint and take part once. A cell with more than ``cell_rows``
fingerprints is split into tiles, each comparing one block of them with another, and a tile
returns a spanning forest of what it links rather than all pairs: no link between groups is
lost, and no group is listed pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, partitions, text_bytes, tiled, written
from .components import connected_components

SEED = 42
FEW_TARGETS = 8


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for no words."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "text"):
            found = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _cells(codes: DataFrame) -> DataFrame:
    """Rows (cell, home, fp): each fingerprint at home in its two cells and a visitor in those
    one popcount above. A pair one apart meets where the one is at home and the other visits."""
    half = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)]
    popcounts = [x - F.shiftright(x, 1).bitwiseAND(F.lit(0x55555555)) for x in half]
    rows = codes.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(h).alias("half"), p.alias("v")) for h, p in enumerate(popcounts)))).alias("at")
    ).select("fp", "at.half", "at.v")
    steps = [F.when(F.col("v").bitwiseAND(F.lit(2 << 2 * i)) == 0, F.lit(1 << 2 * i).cast("long")) for i in range(16)]
    rows = rows.select(
        "fp", "half", "v", F.explode(F.array_compact(F.array(F.lit(0).cast("long"), *steps))).alias("step")
    )
    return rows.select((F.col("half") * (1 << 32) + F.col("v") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("home"), "fp")


def _forest(fp: np.ndarray, targets: np.ndarray, queries: np.ndarray, max_bits: int):
    """Links of a spanning forest: which queries and targets of one tile are connected."""
    nodes = np.unique(np.concatenate([fp[targets], fp[queries]]))
    t, q = np.searchsorted(nodes, fp[targets]), np.searchsorted(nodes, fp[queries])
    label = np.arange(len(nodes))
    for at in t:
        near = q[np.bitwise_count(nodes[q] ^ nodes[at]) <= max_bits]
        other = near[label[near] != label[at]]
        if len(other):
            names, first = np.unique(label[other], return_index=True)
            for x in other[first]:
                yield nodes[at], nodes[x]
            label[np.isin(label, names)] = label[at]


def _links_of_tiles(max_bits: int):
    """Streams tiles sorted by (cell, tile, targets first); keeps one tile's targets at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            cell, tile = (batch.column(c).to_numpy() for c in ("cell", "tile"))
            target, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("target", "query"))
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            if kept_key == (cell[0], tile[0]) and len(kept):
                k = len(kept)
                cell, tile = np.concatenate([np.full(k, cell[0]), cell]), np.concatenate([np.full(k, tile[0]), tile])
                target, query = np.concatenate([np.ones(k, bool), target]), np.concatenate([np.zeros(k, bool), query])
                fp = np.concatenate([kept, fp])
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            n_targets = np.add.reduceat(target.astype(np.int64), starts)
            group = np.repeat(np.arange(len(starts)), sizes)
            a, b = [], []
            few = (n_targets > 0) & (n_targets <= FEW_TARGETS) & (sizes > 1)
            for j in range(FEW_TARGETS):
                rows = np.flatnonzero((few & (n_targets > j))[group])
                if not len(rows):
                    break
                other = fp[starts[group[rows]] + j]
                bits = np.bitwise_count(other ^ fp[rows])
                hit = (bits <= max_bits) & (bits > 0)
                a.append(other[hit])
                b.append(fp[rows][hit])
            for g in np.flatnonzero(n_targets > FEW_TARGETS):
                rows = np.arange(starts[g], starts[g] + sizes[g])
                links = list(_forest(fp, rows[target[rows]], rows, max_bits))
                if links:
                    a.append(np.array([x for x, _ in links], np.uint64))
                    b.append(np.array([y for _, y in links], np.uint64))
            last = starts[-1]
            kept_key, kept = (cell[-1], tile[-1]), fp[last:][target[last:]]
            if a:
                x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                if len(x):
                    yield pa.record_batch([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def fingerprint_links(codes: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all within max_bits (at most 3)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves at Manhattan distance 1 cover at most 3 bits")
    tiles = tiled(_cells(codes), "fp", cell_rows)
    n = partitions(codes.sparkSession)
    return (
        tiles.repartition(n, "cell", "tile")
        .sortWithinPartitions("cell", "tile", F.col("target").desc())
        .mapInArrow(_links_of_tiles(max_bits), "a long, b long")
    )


def simhash_components(docs: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links. Null or blank texts have
    fingerprint zero and link like any other; repeated rows stay; a null doc_id is never the
    smallest unless its group has no other; an empty table gives no rows.
    """
    codes = written(fingerprints(docs))
    groups = codes.groupBy("fp").agg(F.min("doc_id").alias("least"))
    components = written(connected_components(fingerprint_links(groups.select("fp"), max_bits, cell_rows)))
    named = groups.join(components, groups["fp"] == components["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("fp", "component_id")
    return codes.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
