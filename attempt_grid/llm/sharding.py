"""Weighted rendezvous hashing of record keys over shards, in DataFrame expressions.

Every shard draws a number from (key, shard); the shard with the largest weighted draw wins. A
key's draws do not depend on the other shards, so a new shard takes over exactly the keys it
wins, and raising a weight only moves keys towards that shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def winning_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Weights must be positive; all keys that are null share one shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        draw = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        score = draw if len(set(weights)) == 1 else F.lit(-float(weight)) / F.log(draw)
        # on equal scores the smaller shard
        draws.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*draws))["shard"]).cast("int")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, new_weight: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of nothing.
    slot counts a shard's rows from 0 without gaps, grown_shard is the shard with one more of
    weight new_weight. Rows that repeat a key share its shard and have slots of their own.

    Slots need two shuffles of small rows only: rows are numbered within (shard, input block),
    and blocks get their starts from a table of counts, so no shard is gathered in one task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    placed = placed.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        winning_shard(F.col("doc_id"), list(weights)).alias("shard"),
        winning_shard(F.col("doc_id"), [*weights, new_weight]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = written(placed).withColumn("block", F.shiftright("row", 33))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("row")
    numbered = placed.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(written(starts), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("number")).cast("long").alias("slot"), "grown_shard",
    )
