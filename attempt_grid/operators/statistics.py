"""Grouped statistics: one row per level bucket and day, one aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attempt_grid.functions.ratios import percent
from attempt_grid.operators.criteria import AttemptCriteria, attempt_group, filter_attempts

# Statistic columns in output order.
STATISTIC_COLUMNS = (
    "FW_absolute",
    "CW_absolute",
    "CF_absolute",
    "FF_absolute",
    "wins_absolute",
    "fails_absolute",
    "attempts_absolute",
    "failed_absolute",
    "attempt_average",
    "first_attempt_absolute",
    "FW_relative",
    "CW_relative",
    "CF_relative",
    "FF_relative",
    "FW_partial_relative",
    "CW_partial_relative",
    "FF_partial_relative",
    "CF_partial_relative",
    "fail_rate_relative",
    "win_rate_relative",
    "first_attempt_relative",
)
CELL_KEYS = ("level_group", "date")

# Attempt columns that statistics add up.
SUMMED_COLUMNS = ("FW", "CW", "CF", "FF", "failed", "first_attempt")


def aggregate_statistics(
    attempts: DataFrame,
    criteria: AttemptCriteria | None = None,
    *,
    ordered: bool = True,
) -> DataFrame:
    """Filter attempts, group them into cells and derive all 21 statistics.

    Every statistic comes out of sums and counts, so tasks pre-aggregate before
    the only shuffle and a cell that holds most of the rows is no hot spot.
    Pass ``ordered=False`` when another operator follows.
    """
    rows = filter_attempts(attempts, criteria) if criteria else attempts
    return _cells(rows, F.count(F.lit(1)), F.avg("attempt"), ordered)


def segment_totals(attempts: DataFrame) -> DataFrame:
    """Attempts condensed to totals per cell and combination of filterable values.

    Totals have names of their own, so nothing that reads attempts takes them for
    attempts: ``attempt_group`` replaces the number, sums end in ``_total``. Kept as a
    day-partitioned table, the result answers every later request from a fraction of
    the rows, and a new day only adds its own partition.
    """
    return attempts.groupBy(
        "level_cohort",
        "partition_date",
        "payer_type",
        "traffic_type",
        "platform_name",
        attempt_group().alias("attempt_group"),
        "super_ball",
    ).agg(
        *[F.sum(name).alias(f"{name}_total") for name in SUMMED_COLUMNS],
        F.count(F.lit(1)).alias("attempts_total"),
        F.sum("attempt").alias("attempt_sum"),
        F.count("attempt").alias("attempt_count"),
    )


def statistics_from_segments(
    segments: DataFrame,
    criteria: AttemptCriteria | None = None,
    *,
    ordered: bool = True,
) -> DataFrame:
    """The statistics of ``aggregate_statistics``, from condensed attempts."""
    rows = filter_attempts(segments, criteria, condensed=True) if criteria else segments
    average = F.try_divide(F.sum("attempt_sum").cast("double"), F.sum("attempt_count"))
    return _cells(rows, F.sum("attempts_total"), average, ordered, "_total")


def _cells(
    rows: DataFrame, attempts: Column, average: Column, ordered: bool, suffix: str = ""
) -> DataFrame:
    counts = rows.groupBy(
        F.col("level_cohort").cast("int").alias("level_group"),
        F.col("partition_date").cast("date").alias("date"),
    ).agg(
        *[F.sum(name + suffix).cast("double").alias(f"{name}_absolute") for name in SUMMED_COLUMNS],
        attempts.cast("double").alias("attempts_absolute"),
        average.cast("double").alias("attempt_average"),
    )
    totals = counts.withColumns(
        {
            "wins_absolute": F.col("FW_absolute") + F.col("CW_absolute"),
            "fails_absolute": F.col("FF_absolute") + F.col("CF_absolute"),
        }
    )
    statistics = totals.select(
        *CELL_KEYS, *[_statistic(name).alias(name) for name in STATISTIC_COLUMNS]
    )
    return statistics.orderBy(*CELL_KEYS) if ordered else statistics


def _statistic(name: str) -> Column:
    """A statistic in terms of the counted and totalled columns of its cell."""
    if name == "win_rate_relative":
        # By definition what is not failed, also where the outcome is unknown.
        return 100 - _statistic("fail_rate_relative")
    if not name.endswith("_relative"):
        return F.col(name)
    measure = name.removesuffix("_relative")
    whole = "attempts_absolute"
    if measure.endswith("_partial"):
        measure = measure.removesuffix("_partial")
        whole = "wins_absolute" if measure in ("FW", "CW") else "fails_absolute"
    part = "failed_absolute" if measure == "fail_rate" else f"{measure}_absolute"
    return percent(F.col(part), F.col(whole))
