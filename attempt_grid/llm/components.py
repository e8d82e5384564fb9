"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and joins over the links; its result is written to the
shared folder, so lineage stays short and a lost executor costs one round at most. The number
of rounds grows with the logarithm of the longest chain. Minima are combined before each
shuffle, and joins on a hub are plain sort-merge joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b; connects each larger neighbour with the smallest one."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .filter("b <> least")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionAll(least.select("a", F.col("least").alias("b"))).distinct()


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b: long): the smallest node reachable.

    Self links and repeated links are harmless; nulls link nothing; no links give no rows.
    """
    links = written(
        links.filter("a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    while True:
        links = written(_small_star(_large_star(links)))
        last, mark = mark, _mark(links)
        if last == mark:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
