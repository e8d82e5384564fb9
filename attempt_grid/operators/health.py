"""Checks an analyst runs on a freshly built attempt table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attempt_grid.functions.attempts import OUTCOME_SEGMENTS, UNKNOWN_SEGMENT
from attempt_grid.operators.mart import outcome_keys

_CHECKED_ATTRIBUTES = (
    "balance_id",
    "level_cohort",
    "traffic_type",
    "payer_type",
    "platform_name",
    "attempt",
    "super_ball",
)


# Days of one piece of the day axis. The calendar of dates has a few thousand such pieces.
_DAYS_PER_PIECE = 1024


def attempts_per_day(attempts: DataFrame) -> DataFrame:
    """Attempts of every day that has some, and how many days without any lie right before it.

    The first day has NULL days before it. Attempts without a day are a row of their own, with a
    NULL day. A stray day is one more row, however far off.
    """
    counts = attempts.groupBy(F.col("partition_date").cast("date").alias("partition_date")).agg(
        F.count(F.lit(1)).alias("attempts")
    )
    missing = F.datediff("partition_date", "day_before") - 1
    return _with_day_before(counts).select("partition_date", "attempts", missing.alias("missing_before"))


def attempts_per_calendar_day(attempts: DataFrame) -> DataFrame:
    """Attempts on every day from the first to the last; a day without any is a row with 0.

    Columns as in attempts_per_day, also on days without attempts. Attempts without a day are a row
    of their own. Each day present adds the days that lie before it, so there is no bound on the
    span: a stray day costs one row for every day between.
    """
    days = attempts_per_day(attempts)
    missing = F.coalesce("missing_before", F.lit(0))
    filled = days.withColumn("step", F.explode(F.sequence(F.lit(0), missing)))
    empty = F.col("step") < missing
    return filled.select(
        F.date_sub("partition_date", missing - F.col("step")).alias("partition_date"),
        F.when(empty, F.lit(0).cast("long")).otherwise(F.col("attempts")).alias("attempts"),
        F.when(empty, F.col("step")).otherwise(F.col("missing_before")).alias("missing_before"),
    )


def _with_day_before(counts: DataFrame) -> DataFrame:
    """Adds ``day_before``, the last day before the row's own that is present.

    The day axis is cut into pieces of fixed length. Inside a piece a window finds the day before;
    a piece's first day takes the last one of the pieces before, found on one row for each piece.
    """
    piece = F.floor(F.unix_date("partition_date") / F.lit(_DAYS_PER_PIECE))
    days = counts.withColumn("piece", piece)
    inside = F.lag("partition_date").over(Window.partitionBy("piece").orderBy("partition_date"))
    ends = days.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.max("partition_date").alias("last"))
    carried = ends.select(
        F.col("piece").alias("of_piece"), F.lag("last").over(Window.orderBy("piece")).alias("carried")
    )
    joined = days.withColumn("inside", inside).join(F.broadcast(carried), F.col("piece") == F.col("of_piece"), "left")
    return joined.select(*counts.columns, F.coalesce("inside", "carried").alias("day_before"))


def day_gaps(attempts: DataFrame) -> DataFrame:
    """Runs of days without attempts between days with some: first and last of them and their number."""
    days = attempts_per_day(attempts).filter(F.col("missing_before") > 0)
    return days.select(
        F.date_sub("partition_date", F.col("missing_before")).alias("first_missing"),
        F.date_sub("partition_date", F.lit(1)).alias("last_missing"),
        F.col("missing_before").alias("days"),
    )


def day_runs(attempts: DataFrame) -> DataFrame:
    """Runs of consecutive days with attempts: first and last day, number of days and attempts.

    The numbers of a run follow from sums over the days so far, again piece by piece.
    """
    days = attempts_per_day(attempts).filter(F.col("partition_date").isNotNull())
    starts = (F.coalesce("missing_before", F.lit(1)) > 0).cast("int")
    days = days.withColumns({"starts": starts, "piece": F.floor(F.unix_date("partition_date") / F.lit(_DAYS_PER_PIECE))})
    so_far = F.sum("starts").over(Window.partitionBy("piece").orderBy("partition_date"))
    before = days.groupBy("piece").agg(F.sum("starts").alias("in_piece"))
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = before.select(F.col("piece").alias("of_piece"), F.coalesce(F.sum("in_piece").over(earlier), F.lit(0)).alias("carried"))
    numbered = days.withColumn("so_far", so_far).join(F.broadcast(carried), F.col("piece") == F.col("of_piece"))
    return (
        numbered.groupBy((F.col("carried") + F.col("so_far")).alias("run"))
        .agg(
            F.min("partition_date").alias("first_day"),
            F.max("partition_date").alias("last_day"),
            F.count(F.lit(1)).alias("days"),
            F.sum("attempts").alias("attempts"),
        )
        .drop("run")
    )


def attempts_per_bucket(attempts: DataFrame) -> DataFrame:
    """Attempts in every level bucket; the NULL bucket holds unreadable level ids."""
    return attempts.groupBy("level_cohort").agg(F.count(F.lit(1)).alias("attempts"))


def missing_values(attempts: DataFrame) -> DataFrame:
    """One row: attempts, missing attributes and attempts of unknown outcome."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in _CHECKED_ATTRIBUTES]
    return attempts.agg(
        F.count(F.lit(1)).alias("attempts"),
        *missing,
        F.count_if(F.col("reason_seg") == UNKNOWN_SEGMENT).alias("unknown_outcome"),
    )


def players_with_many_traffic_types(players: DataFrame) -> DataFrame:
    """Eligible players whose attempts are repeated because of several traffic types."""
    return (
        players.groupBy("user_id")
        .agg(F.count_distinct("traffic_type").alias("traffic_types"))
        .filter(F.col("traffic_types") > 1)
    )


def repeated_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcome keys that occur more than once and therefore repeat attempts."""
    return (
        outcomes.select(*outcome_keys(outcomes), *OUTCOME_SEGMENTS)
        .groupBy(*outcome_keys(outcomes))
        .agg(F.count(F.lit(1)).alias("outcome_rows"))
        .filter(F.col("outcome_rows") > 1)
    )
