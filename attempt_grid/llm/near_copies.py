"""Near copies by word shingles: SimHash groups and MinHash bands name candidates, exact Jaccard similarity links them.

The groups are those of op9's operator: fingerprints within 3 bits, found over a grid of segment
popcounts. Beside them, a text's signature holds the least hash of its shingles under ``BANDS * ROWS`` functions. Texts
that agree in all rows of a band share a bucket; at similarity 0.8 that fails for all 24 bands of
5 rows in fewer than one of 10,000 pairs. Nothing is linked by its fingerprint or signature: each
candidate is settled by the two sets of shingles.

Equal texts take part once. A SimHash group is a bucket like those of the bands. A bucket's members are first compared with its smallest one, which
settles buckets of two and groups of copies in linear time. In buckets that still hold several
components the members outside the largest one are compared with all, in tiles, where sizes and
signatures sort out pairs that cannot reach the similarity. A set of shingles travels once for
each tile that it is in; tasks return links, a forest for each tile, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, key_test, partitions, text_bytes, written
from .components import connected_components
from .simhash import simhash_components

SEED = 42
BANDS, ROWS = 24, 5
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
# How far a signature may lie below the similarity: over five standard deviations at 0.8.
SLACK = 0.2


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; a shorter text is one shingle."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, (shingles[at : at + 512, None] * FACTORS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, size, sig): the text's hash, its number of shingles and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches, "text"):
            sets = [shingle_set(t, width) for t in text_bytes(chunk.column("text"))]
            yield pa.record_batch(
                [chunk.column("doc_id"), chunk.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                ["doc_id", "key", "size", "sig"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), _key().alias("key"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, key long, size long, sig binary")


def _groups(docs: DataFrame) -> DataFrame:
    """(key, group): the SimHash component of each distinct text, as a bucket's name."""
    found = simhash_components(docs.select(_key().alias("doc_id"), "text"))
    return found.select(F.col("doc_id").alias("key"), F.xxhash64(F.lit(BANDS), "component_id").alias("group")).distinct()


def _sets(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of the keys' texts: each set once, as bytes.

    Tasks drop copies before the shuffle, and texts of other keys are not shuffled at all."""

    texts = docs.select(_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed, part = key_test(texts, "key", keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(part(True)(batches), "text"):
            sets = dict(zip(chunk.column("key").to_pylist(), text_bytes(chunk.column("text"))))
            sets = {key: shingle_set(text, width).tobytes() for key, text in sets.items()}
            yield pa.record_batch([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], ["key", "shingles"])

    found = hashed.mapInArrow(run, "key long, shingles binary")
    return written(found.groupBy("key").agg(F.first("shingles").alias("shingles")))


TILE_COLUMNS = ("cell", "tile", "band", "target", "minor", "key", "component", "size", "sig", "shingles")


def _links_of_tiles(least: float):
    """Links (a, b) that join components, found by comparing a tile's queries with its targets.

    Streams tiles sorted by (cell, tile, targets first) and keeps one tile's targets. What was
    linked within the tile is not compared again, so its links form a forest. In the bucket of a
    band only pairs are compared that share no band before; those meet in the bucket of that one.
    A SimHash group comes after all bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile_key, targets, table = None, [], None
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = c = above.get(up, up)
            return c

        for batch in batches:
            out = []
            for cell, tile, band, target, minor, key, component, size, sig, raw in zip(*(batch.column(c).to_pylist() for c in TILE_COLUMNS)):
                if tile_key != (cell, tile):
                    tile_key, targets, table = (cell, tile), [], None
                    above.clear()
                sig, shingles = np.frombuffer(sig, "<u4"), np.frombuffer(raw, np.uint64)
                if target:
                    targets.append((key, component, size, minor, sig, shingles))
                    continue
                if not targets:
                    continue
                if table is None:
                    table = [np.array([t[i] for t in targets]) for i in range(4)] + [np.stack([t[4] for t in targets])]
                keys, components, sizes, minors, sigs = table
                # two queries meet once
                fits = (keys != key) & (components != component) & (~minors | (keys > key))
                fits &= np.minimum(sizes, size) >= least * np.maximum(sizes, size) - 1e-9
                some = np.flatnonzero(fits)
                equal = sigs[some] == sig
                near = equal.mean(axis=1) >= least - SLACK
                if band >= 0:
                    bands = equal.reshape(-1, BANDS, ROWS).all(axis=2)
                    near &= np.where(bands.any(axis=1), bands.argmax(axis=1), BANDS) == band
                for t in some[near]:
                    mine, other = root(component), root(int(components[t]))
                    if mine != other and similarity(shingles, targets[t][5]) >= least - 1e-9:
                        above[max(mine, other)] = min(mine, other)
                        out.append((key, int(keys[t])))
            if out:
                a, b = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _compared(tiles: DataFrame, one: DataFrame, sets: DataFrame, least: float, parts: int) -> DataFrame:
    """Links found in tiles (cell, tile, band, target, minor, key, component)."""
    rows = tiles.join(one.select("key", "size", "sig"), "key").join(sets, "key").select(*TILE_COLUMNS)
    dealt = rows.repartition(parts, "cell", "tile").sortWithinPartitions("cell", "tile", F.col("target").desc())
    return written(dealt.mapInArrow(_links_of_tiles(least), "a long, b long"))


def _star_tiles(listed: DataFrame, least: float, star_rows: int) -> DataFrame:
    """Every member of a bucket as query to the bucket's smallest key."""
    fits = F.least("size", "first.size") >= least * F.greatest("size", "first.size") - 1e-9
    stars = listed.filter((F.col("key") != F.col("first.key")) & fits).select(F.col("first.key").alias("cell"), "key").distinct()
    blocks = stars.groupBy("cell").agg(F.ceil(F.count("*") / star_rows).alias("blocks"))
    dealt = stars.join(blocks, "cell").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    row = lambda target, key: [F.lit(-1).alias("band"), F.lit(target).alias("target"), F.lit(False).alias("minor"), key, key.alias("component")]
    queries = dealt.select("cell", "tile", *row(False, F.col("key")))
    centres = dealt.select("cell", "tile").distinct()
    return queries.unionAll(centres.select("cell", "tile", *row(True, F.col("cell").alias("key"))))


def _mixed_tiles(listed: DataFrame, components: DataFrame, cell_rows: int) -> DataFrame:
    """Members of buckets that hold several components: those outside the largest one as queries to all.

    A bucket of one large component and few others so stays linear in its size."""
    members = listed.filter("n > 2").join(components.withColumnRenamed("node", "key"), "key", "left")
    members = written(members.select("cell", "band", "key", F.coalesce("component", "key").alias("component")))
    each = members.groupBy("cell", "component").agg(F.count("*").alias("n"))
    mixed = (
        each.groupBy("cell")
        .agg(F.max(F.struct("n", "component")).alias("major"), F.count("*").alias("k"), F.sum("n").alias("n"))
        .filter("k > 1")
        .select(
            "cell",
            F.col("major.component").alias("major"),
            F.ceil(F.col("n") / cell_rows).cast("int").alias("of_targets"),
            F.ceil((F.col("n") - F.col("major.n")) / cell_rows).cast("int").alias("of_queries"),
        )
    )
    rows = members.join(mixed, "cell").withColumn("minor", F.col("component") != F.col("major"))
    mine = F.pmod(F.xxhash64("key"), F.col("of_targets")).cast("int")
    asks = F.pmod(F.xxhash64("key", F.lit(1)), F.col("of_queries")).cast("int")
    part = lambda tile, target: F.struct(tile.alias("tile"), F.lit(target).alias("target"))
    as_target = F.transform(F.sequence(F.lit(0), F.col("of_queries") - 1), lambda j: part(mine * F.col("of_queries") + j, True))
    as_query = F.transform(F.sequence(F.lit(0), F.col("of_targets") - 1), lambda i: part(i * F.col("of_queries") + asks, False))
    parts = F.when(F.col("minor"), F.concat(as_target, as_query)).otherwise(as_target)
    dealt = rows.withColumn("part", F.explode(parts))
    return dealt.select("cell", "part.tile", "band", "part.target", "minor", "key", "component")


def near_copy_components(
    docs: DataFrame, width: int = 5, least: float = 0.8, cell_rows: int = 256, star_rows: int = 4096
) -> DataFrame:
    """One row per document: doc_id, component_id.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more
    are linked; component_id is the smallest doc_id reachable over links. Null and blank texts
    are alike; a null doc_id is never the smallest unless its group has no other.
    """
    parts = partitions(docs.sparkSession)
    sketches = written(_sketches(docs, width))
    one = sketches.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    one = written(one.join(_groups(docs), "key"))
    bands = [F.xxhash64(F.lit(k), F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)]
    members = one.select("key", "size", F.posexplode(F.array(*bands, "group")).alias("band", "cell"))
    buckets = (
        members.groupBy("cell", "band")
        .agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("first"), F.bit_xor(F.xxhash64("key")).alias("mark"))
        .filter("n > 1")
    )
    # bands with the same members are compared once, in the first of them
    place = F.min(F.struct("band", "cell"))
    buckets = written(buckets.groupBy("n", "first", "mark").agg(place.alias("place")).select("n", "first", "place.band", "place.cell"))
    listed = written(members.join(buckets, ["cell", "band"]).select("cell", "band", "n", "first", "key", "size"))
    sets = _sets(docs, listed.select("key").distinct(), width)
    links = _compared(_star_tiles(listed, least, star_rows), one, sets, least, parts)
    components = written(connected_components(links))
    more = _compared(_mixed_tiles(listed, components, cell_rows), one, sets, least, parts)
    if not more.isEmpty():
        components = written(connected_components(links.unionAll(more)))

    named = one.join(components, one["key"] == components["node"], "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select("key", "component_id")
    return sketches.join(named, "key").select("doc_id", "component_id")
