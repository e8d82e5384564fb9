"""Segment totals kept up to date by signed deltas.

Totals add up, so attempts that come late, or are withdrawn, change them by the totals of just
those attempts, with a sign. Deltas are kept run by run: a run that is repeated replaces its own
delta and so counts once, whatever it had written before. Merged by cell, the runs give what
``segment_totals`` gives on all attempts that are left, without reading any of them again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.operators.criteria import attempt_group
from attempt_grid.operators.statistics import SUMMED_COLUMNS

SEGMENT_KEYS = ("level_cohort", "partition_date", "payer_type", "traffic_type", "platform_name", "attempt_group", "super_ball")
TOTALS = (*(f"{name}_total" for name in SUMMED_COLUMNS), "attempts_total", "attempt_sum", "attempt_count")
# How many values a sum is made of: a sum of none is NULL, one of values that cancel out is 0.
KNOWN = tuple(f"{name}_known" for name in SUMMED_COLUMNS)
RUN_COLUMN = "run_id"
_RUN_ID = re.compile("[A-Za-z0-9_-]{1,100}")


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    known = [F.count(name).alias(f"{name}_known") for name in SUMMED_COLUMNS]
    totals = [F.sum(name).alias(f"{name}_total") for name in SUMMED_COLUMNS]
    grouped = rows.groupBy(*SEGMENT_KEYS[:5], attempt_group().alias("attempt_group"), "super_ball").agg(
        *totals,
        F.count(F.lit(1)).alias("attempts_total"),
        F.sum("attempt").alias("attempt_sum"),
        F.count("attempt").alias("attempt_count"),
        *known,
    )
    # A sum of nothing is no change.
    return grouped.select(*SEGMENT_KEYS, *[(sign * F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in (*TOTALS, *KNOWN)])


def segment_deltas(added: DataFrame | None = None, withdrawn: DataFrame | None = None) -> DataFrame:
    """By cell and filterable values, what attempts that come in or are withdrawn change.

    A corrected attempt is both: withdrawn as it was and added as it is. Withdrawing needs the
    rows as they were counted.
    """
    parts = [_signed(rows, sign) for rows, sign in ((added, 1), (withdrawn, -1)) if rows is not None]
    if not parts:
        raise ValueError("neither added nor withdrawn attempts")
    both = reduce(DataFrame.unionByName, parts)
    return _summed(both).filter(reduce(Column.__or__, [F.col(c) != 0 for c in (*TOTALS, *KNOWN)]))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*SEGMENT_KEYS).agg(*[F.sum(c).alias(c) for c in (*TOTALS, *KNOWN)])


def write_run(deltas: DataFrame, path: str, run_id: str) -> None:
    """Store a run's deltas below ``path``, replacing what the same run wrote before.

    Other runs are not touched. A run that finds nothing to change replaces its former delta by
    a row of zeros, which changes nothing either.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"{run_id!r} is no run id: letters, digits, '-' and '_'")
    spark = deltas.sparkSession
    fields = deltas.select(*SEGMENT_KEYS, *TOTALS, *KNOWN).schema
    zeros = spark.range(1, numPartitions=1).select(
        *[F.lit(0 if f.name in (*TOTALS, *KNOWN) else None).cast(f.dataType).alias(f.name) for f in fields]
    )
    rows = deltas.select(*fields.names).unionAll(zeros).withColumn(RUN_COLUMN, F.lit(run_id))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN_COLUMN)
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The deltas of all runs below ``path``."""
    return spark.read.parquet(path)


def merged_segments(runs: DataFrame) -> DataFrame:
    """The ``segment_totals`` of all attempts that were added and not withdrawn.

    The job fails where more was withdrawn than had been added: such a run withdrew rows that it
    had never counted.
    """
    summed = _summed(runs)
    counts = ("attempts_total", "attempt_count", *KNOWN)
    negative = reduce(Column.__or__, [F.col(c) < 0 for c in counts])
    left = F.when(negative, F.raise_error(F.lit("more attempts withdrawn from a segment than were added")).cast("boolean"))
    cells = summed.filter(F.coalesce(left, F.col("attempts_total") > 0))
    sums = [F.when(F.col(f"{c}_known") > 0, F.col(f"{c}_total")).alias(f"{c}_total") for c in SUMMED_COLUMNS]
    return cells.select(
        *SEGMENT_KEYS, *sums, "attempts_total", F.when(F.col("attempt_count") > 0, F.col("attempt_sum")).alias("attempt_sum"), "attempt_count"
    )


def compact_runs(spark: SparkSession, path: str, into: str, run_id: str) -> None:
    """Condense all runs below ``path`` to one, below a new path; the old one is the caller's to drop.

    As the new path holds one run or nothing, a crash in between leaves nothing half condensed.
    """
    if path.rstrip("/") == into.rstrip("/"):
        raise ValueError("runs are condensed into a new path")
    summed = _summed(read_runs(spark, path))
    write_run(summed.filter(reduce(Column.__or__, [F.col(c) != 0 for c in (*TOTALS, *KNOWN)])), into, run_id)

