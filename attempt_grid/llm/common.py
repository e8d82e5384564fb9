"""What several corpus operators share: shared folders, per-process stores, text as bytes."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def is_local(master: str) -> bool:
    """True where driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local master, whose executors are the driver itself, gets a
    temporary folder; on a cluster that would lose rows, so it is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = shared_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _give_back() -> None:
    """Memory that is free but still held by this process goes back to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def process_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process, across its tasks.

    A worker holds one of them: asking for another lets go of what an earlier job left."""
    home = sys.modules.setdefault("_corpus_process_store", types.ModuleType("_corpus_process_store"))
    others = [k for k in home.__dict__ if k.startswith("store_") and k != f"store_{name}"]
    for other in others:
        del home.__dict__[other]
    if others or f"store_{name}" not in home.__dict__:
        _give_back()
    return home.__dict__.setdefault(f"store_{name}", {})


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def in_chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about most_bytes of text each; a longer text comes alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        first = total = 0
        for row, size in enumerate(sizes):
            if row > first and total + size > most_bytes:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += size
        if first < batch.num_rows:
            yield batch.slice(first)


# A filter of keys has this many bits, 8 MB, whatever it is filled with.
FILTER_BITS = 1 << 26
HASH_COLUMN = "__key_hash"


def _key_bits(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys (first column): two bits for each."""
    hashed = F.xxhash64(keys.columns[0])
    mask = F.lit(FILTER_BITS - 1)
    places = F.array(hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 26).bitwiseAND(mask))
    bits = keys.filter(F.col(keys.columns[0]).isNotNull()).select(F.explode(places).alias("bit"))
    octet = F.bit_or(F.expr("shiftleft(1, CAST(bit & 7 AS INT))"))
    found = bits.groupBy(F.shiftright("bit", 3).alias("place")).agg(octet.alias("octet")).toArrow()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[found.column("place").to_numpy()] = found.column("octet").to_numpy().astype(np.uint8)
    return table


Batches = Iterator[pa.RecordBatch]


def key_test(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, Callable[[bool], Callable[[Batches], Batches]]]:
    """(the rows with a hash of their key, a function that tells them apart by a filter of fixed size).

    Inside mapInArrow over the hashed rows, the function gives the rows that may have one of the
    keys (True) or the rest, which have none (False), without the hash. What only concerns the rows
    of some keys then shuffles these and few others. The more keys, the more others; none with a
    key is ever among the rest. A null key is never among the keys.
    """
    bits = rows.sparkSession.sparkContext.broadcast(_key_bits(keys))
    key = F.col(column)
    hashed = rows.withColumn(HASH_COLUMN, F.when(key.isNotNull(), F.xxhash64(key.cast(keys.schema[0].dataType))))

    def part(wanted: bool) -> Callable[[Batches], Batches]:
        def run(batches: Batches) -> Batches:
            table = bits.value
            for batch in batches:
                column = batch.column(HASH_COLUMN)
                h = column.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
                may = column.is_valid().to_numpy(zero_copy_only=False)
                for place in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(26)) & np.uint64(FILTER_BITS - 1)):
                    may = may & ((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                some = batch.filter(pa.array(may == wanted))
                yield some.select([n for n in some.schema.names if n != HASH_COLUMN])

        return run

    return hashed, part


def split_by_keys(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, the rest) as ``key_test`` tells. Each reads the rows once."""
    hashed, part = key_test(rows, column, keys)
    return hashed.mapInArrow(part(True), rows.schema), hashed.mapInArrow(part(False), rows.schema)


def tiled(rows: DataFrame, item: str, most: int) -> DataFrame:
    """Splits crowded cells for a comparison of their members: adds tile, target and query.

    rows have cell, home, the column item and others. Home rows of a cell are compared with each
    other and with its visitors. A cell of up to ``most`` home rows is one tile; a larger one is a
    square of tiles, where tile (i, q) compares the i-th block of home rows as targets with the
    q-th block of all rows as queries. Blocks are dealt by the hash of item.
    """
    others = [c for c in rows.columns if c not in ("cell", "home")]
    crowded = written(
        rows.filter("home").groupBy("cell").count().filter(F.col("count") > most).select(
            "cell", F.ceil(F.col("count") / most).cast("int").alias("blocks")
        )
    )
    n = crowded.count()
    if n == 0:
        return rows.select("cell", F.lit(0).alias("tile"), F.col("home").alias("target"), F.lit(True).alias("query"), "home", *others)
    # at most one row for every ``most`` rows; joined the usual way where that is still large
    joined = rows.join(F.broadcast(crowded) if n <= 1_000_000 else crowded, "cell", "left")
    mine = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    part = lambda tile, target, query: F.struct(tile.alias("tile"), target.alias("target"), query.alias("query"))
    no, yes = F.lit(False), F.lit(True)
    as_query = F.transform(each, lambda i: part(i * F.col("blocks") + mine, no, yes))
    as_target = F.transform(each, lambda q: part(mine * F.col("blocks") + q, yes, no))
    parts = (
        F.when(F.col("blocks").isNull(), F.array(part(F.lit(0), F.col("home"), yes)))
        .when(F.col("home"), F.concat(as_query, as_target))
        .otherwise(as_query)
    )
    return joined.select("cell", "home", *others, F.explode(parts).alias("p")).select("cell", "p.tile", "p.target", "p.query", "home", *others)
