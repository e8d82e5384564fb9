"""Attempt table builds: raw level events and player state to one row per attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attempt_grid.functions.attempts import (
    UNKNOWN_SEGMENT,
    indicator,
    is_first_attempt,
    level_bucket,
    level_number,
    segment_flags,
)
from attempt_grid.functions.casts import truth_value, whole_number
from attempt_grid.operators import mart
from attempt_grid.operators.criteria import DateLike, Limits
from attempt_grid.sinks.day_refresh import Days, refresh_days
from attempt_grid.sinks.tables import overwrite_table

# Output columns of the two builds.
PAYLOAD_BUILD_COLUMNS = (
    *mart.ATTEMPT_KEY,
    "traffic_type",
    "payer_type",
    "failed",
    "reason_seg",
    "attempt",
    "super_ball",
    "platform_name",
    "first_attempt",
    "level_cohort",
    "FW",
    "CW",
    "CF",
    "FF",
)
OUTCOME_BUILD_COLUMNS = (
    *mart.ATTEMPT_KEY,
    "traffic_type",
    "payer_type",
    "failed",
    "ab_group",
    "attempt",
    "platform_name",
    "super_ball",
    "first_attempt",
    "FW",
    "CW",
    "CF",
    "FF",
    "reason_seg",
    "level_cohort",
)


def _parsed(events: DataFrame, payload_keys: tuple[str, ...], *carried: str | Column) -> DataFrame:
    """Events reduced to what an attempt needs; each JSON text is parsed once.

    This happens before any join, so a shuffle moves short fields, not payloads.
    """
    fields = events.select(
        "client_time",
        "user_id",
        "partition_date",
        "payer_type",
        indicator(F.col("reason") == "failed").alias("failed"),
        *carried,
        F.json_tuple("event_payload", "balance_id", *payload_keys).alias("level_id", *payload_keys),
        F.json_tuple("user_payload", mart.PLATFORM_KEY).alias("platform_name"),
    )
    return fields.withColumn("balance_id", level_number(F.col("level_id"))).drop("level_id")


def _of_listed(events: DataFrame, user_ids: mart.UserIds | None) -> DataFrame:
    """A short list of players is a condition on the event scan as well."""
    return events if user_ids is None or isinstance(user_ids, DataFrame) else mart.of_users(events, user_ids)


def attempts_from_payload(
    levels: DataFrame,
    players: DataFrame,
    *,
    bucket_width: float,
    cutoff: DateLike,
    user_ids: mart.UserIds | None = None,
    broadcast_bytes: int | None = mart.BROADCAST_BYTES,
    days: Limits = Limits(),
) -> DataFrame:
    """Attempts whose outcome segment is in the event payload, of all days or the given ones."""
    events = mart.finished_events(mart.on_days(levels, days))
    events = _of_listed(mart.after_cutoff(mart.without_chain(events), cutoff), user_ids)
    attempts = _parsed(events, ("reason_seg", "attempt", "super_ball")).fillna(
        UNKNOWN_SEGMENT, subset="reason_seg"
    )
    attempts = mart.join_players(
        attempts, mart.eligible_players(players, user_ids), broadcast_bytes
    )
    derived = {
        "first_attempt": is_first_attempt(F.col("attempt"), attempts.schema["attempt"].dataType),
        "level_cohort": level_bucket(F.col("balance_id"), bucket_width),
        **segment_flags(F.col("reason_seg")),
    }
    return attempts.withColumns(derived).select(*PAYLOAD_BUILD_COLUMNS)


def attempts_from_outcomes(
    levels: DataFrame,
    players: DataFrame,
    outcomes: DataFrame,
    *,
    bucket_width: float,
    cutoff: DateLike,
    max_drift_seconds: int = mart.MAX_CLOCK_DRIFT_SECONDS,
    user_ids: mart.UserIds | None = None,
    broadcast_bytes: int | None = mart.BROADCAST_BYTES,
    days: Limits = Limits(),
) -> DataFrame:
    """Attempts whose outcome flags come from a table of their own, of all days or the given ones."""
    events = mart.within_drift(mart.on_days(levels, days), max_drift_seconds)
    if "partition_date" in outcomes.columns:
        outcomes = mart.on_days(outcomes, days)
    events = mart.chain_not_like(mart.finished_events(events))
    events = _of_listed(mart.after_cutoff(events, cutoff), user_ids)
    number = whole_number(F.col("attempt"), events.schema["attempt"].dataType)
    attempts = _parsed(events, ("super_ball",), "ab_group", number.alias("attempt"))
    attempts = mart.join_players(
        attempts, mart.eligible_players(players, user_ids), broadcast_bytes
    )
    attempts = mart.with_flags_segment(mart.join_outcomes(attempts, outcomes))
    derived = {
        "first_attempt": is_first_attempt(F.col("attempt"), attempts.schema["attempt"].dataType),
        "level_cohort": level_bucket(F.col("balance_id"), bucket_width),
    }
    return attempts.withColumns(derived).select(*OUTCOME_BUILD_COLUMNS)


def typed(attempts: DataFrame) -> DataFrame:
    """A built table with ``attempt`` and ``super_ball`` as number and boolean.

    JSON gives text. Stored with their contract types, both can be filtered in
    the parquet scan of every later query.
    """
    types = attempts.schema
    return attempts.withColumns(
        {
            "attempt": whole_number(F.col("attempt"), types["attempt"].dataType),
            "super_ball": truth_value(F.col("super_ball"), types["super_ball"].dataType),
        }
    )


def rebuild_table(
    attempts: DataFrame,
    name: str,
    *,
    replace_schema: bool = False,
    cluster: bool = True,
    only_present_days: bool = False,
    days: Days | None = None,
) -> Days | None:
    """Write a build as its day-partitioned table and return the days it replaced, None for all.

    ``days`` are the requested days of the build: they are replaced, also by nothing, and the rest
    of the table stays. ``only_present_days`` takes those that occur in the build.
    """
    rows, options = typed(attempts), {"replace_schema": replace_schema, "cluster": cluster}
    if days is not None or only_present_days:
        return refresh_days(rows, name, days, **options)
    overwrite_table(rows, name, **options)
    return None
