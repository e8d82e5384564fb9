"""CSV with line breaks inside quotes, read in parts of a file.

Whether a line starts inside quotes depends on all quotes before it, so a file with quoted line
breaks is usually read as a whole. Only the parity matters, though, and it adds up: each part of a
file counts its quotes, running sums over the parts, one row each, tell how a part starts, and
then every part finds its records by itself. Records that fill one line, nearly all, go on from
there; lines of longer records meet by the number of their record.

Headers are mapped file by file, so files may order their columns differently.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attempt_grid.operators.contract import ATTEMPT_COLUMNS, ContractError, to_contract

MAX_RECORD_LINES = 10_000
_PART = ["file", "block"]


def _odd_quotes(lines: pa.Array) -> np.ndarray:
    """1 where a line holds an odd number of quotes; doubled quotes do not matter."""
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that come from one part of a file, in order."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    first = 0
    for at in range(1, batch.num_rows + 1):
        if at == batch.num_rows or files[at] != files[first] or blocks[at] != blocks[first]:
            yield files[first], blocks[first], batch.slice(first, at - first)
            first = at


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: the parity of its quotes, how many records start in it if it starts outside
    or inside quotes, and its first line."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, block, some in _groups(batch):
            own = found.setdefault((file, block), [0, 0, 0, some.column("value")[0].as_py()])
            odd = _odd_quotes(some.column("value"))
            inside = (own[0] + np.cumsum(odd) - odd) & 1
            own[1] += int((inside == 0).sum())
            own[2] += int((inside == 1).sum())
            own[0] = (own[0] + int(odd.sum())) & 1
    if found:
        rows = [(*key, *values) for key, values in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(["file", "block", "odd", "starts_outside", "starts_inside", "first_line"], r)) for r in rows])


def _number_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers each line's record; ``whole`` says that the line is all of it."""
    state: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, block, some in _groups(batch):
            own = state.setdefault((file, block), [some.column("inside")[0].as_py(), some.column("before")[0].as_py(), 0])
            odd = _odd_quotes(some.column("value"))
            inside = (own[0] + np.cumsum(odd) - odd) & 1
            starts = inside == 0
            record = own[1] + np.cumsum(starts) - 1
            place = own[2] + np.arange(len(odd))
            own[:] = [(own[0] + int(odd.sum())) & 1, own[1] + int(starts.sum()), own[2] + len(odd)]
            columns = [some.column(c) for c in ("file", "block", "positions", "value")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(record), pa.array(place), pa.array(starts & (odd == 0))],
                ["file", "block", "positions", "value", "record", "place", "whole"],
            )


def _positions(headers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Where each file has the wanted columns. Fetches one row for each different header."""
    texts = [r["header"] for r in headers.select("header").distinct().collect()]
    found = []
    for text in texts:
        names = [n.strip() for n in next(csv.reader([text.removeprefix("﻿").rstrip("\r")]), [])]
        missing = sorted(set(columns) - set(names))
        if missing:
            raise ContractError(f"a file with the header {text!r} lacks the columns {', '.join(missing)}")
        found.append((text, [names.index(c) for c in columns], len(names)))
    spark = headers.sparkSession
    mapped = spark.createDataFrame(found, "header string, positions array<int>, width int")
    return headers.join(F.broadcast(mapped), "header").select("file", "positions", "width")


def read_csv_records(
    spark: SparkSession, path: str, columns: Sequence[str], *, max_record_lines: int = MAX_RECORD_LINES
) -> DataFrame:
    """The columns of CSV files with a header line, as text, by name.

    The rows are those of Spark's reader with ``multiLine``, doubled quotes for a quote and an
    empty unquoted field as NULL; large files are read by many tasks. Counting quotes reads the
    text once more. A record of more than ``max_record_lines`` lines, most likely a quote that is
    never closed, fails the job. Blank lines are skipped; the header is one line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    parts = lines.mapInArrow(
        _count_quotes, "file string, block long, odd long, starts_outside long, starts_inside long, first_line string"
    ).persist()
    try:
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
        known = parts.withColumn("inside", inside)
        starts = F.when(F.col("inside") == 1, F.col("starts_inside")).otherwise(F.col("starts_outside"))
        known = known.withColumn("starts", starts)
        known = known.withColumn("before", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
        headers = parts.filter("block = 0").select("file", F.col("first_line").alias("header"))
        places = _positions(headers, columns)
        width = places.agg(F.max("width")).first()[0] or 1
        rows = known.join(places, "file").select(*_PART, "inside", "before", "positions").collect()
    finally:
        parts.unpersist()
    # One row for each part of a file, about 128 MB of input.
    starts = F.broadcast(spark.createDataFrame(rows, "file string, block long, inside long, before long, positions array<int>"))
    numbered = lines.join(starts, _PART).mapInArrow(
        _number_records, "file string, block long, positions array<int>, value string, record long, place long, whole boolean"
    ).filter("record > 0")
    pieces = numbered.filter("NOT whole").groupBy("file", "record")
    long = F.raise_error(F.concat(F.lit("a record does not end within its lines, is a quote never closed? "), F.col("file")))
    sizes = pieces.agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > max_record_lines)
    unclosed = sizes.select("file", F.lit(True).alias("unclosed")).distinct()
    cut = numbered.filter("NOT whole").join(F.broadcast(unclosed), "file", "left")
    checked = cut.filter(F.when(F.col("unclosed"), long.cast("boolean")).otherwise(F.lit(True)))
    piece = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    joined = checked.groupBy("file", "record").agg(piece.alias("lines"), F.first("positions").alias("positions"))
    records = numbered.filter("whole").select("value", "positions").unionAll(
        joined.select(F.array_join("lines.value", "\n").alias("value"), "positions")
    )
    # As the whole-file reader does, in files whose lines end so.
    unified = F.replace(F.left("value", F.length("value") - 1), F.lit("\r\n"), F.lit("\n"))
    text = F.when(F.endswith("value", F.lit("\r")), unified).otherwise(F.col("value"))
    fields = ", ".join(f"f{i} string" for i in range(width))
    parsed = F.from_csv(text, fields, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    row = records.filter(F.trim(text) != "").select("positions", parsed.alias("p"))
    values = F.array(*[F.col(f"p.f{i}") for i in range(width)])
    row = row.select("positions", values.alias("v"))
    return row.select(*[F.get("v", F.get("positions", F.lit(j))).alias(c) for j, c in enumerate(columns)])


def read_attempts_csv_parts(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """``read_attempts_csv`` with ``multi_line`` for large files: read in parts, headers file by file."""
    return to_contract(read_csv_records(spark, str(path), ATTEMPT_COLUMNS), strict=strict)
