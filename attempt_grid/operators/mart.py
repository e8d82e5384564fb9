"""Steps that turn raw level events and player state into attempt rows."""

from __future__ import annotations

import operator
from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attempt_grid.functions.attempts import OUTCOME_SEGMENTS, flags_segment
from attempt_grid.operators.criteria import DateLike, Limits, as_day
from attempt_grid.sinks.tables import keep

# What makes an event a finished attempt of an eligible player.
FINISHED_EVENT = "m3.level_finished"
FINISHED_REASONS = ("completed", "failed")
ELIGIBLE_CHEATER_STATES = ("Fair", "Soft")
EXCLUDED_CHAIN_PATTERN = "WL_%"
MAX_CLOCK_DRIFT_SECONDS = 3 * 86400
PLATFORM_KEY = "tech.platform_name"

# Columns that identify an attempt.
ATTEMPT_KEY = ("client_time", "balance_id", "user_id", "partition_date")


# A short list of user ids, or a DataFrame with a user_id column for a long one.
UserIds = Collection[str] | DataFrame


def of_users(rows: DataFrame, user_ids: UserIds) -> DataFrame:
    """Rows of the listed users."""
    if isinstance(user_ids, DataFrame):
        return rows.join(user_ids.select("user_id"), "user_id", "left_semi")
    return rows.filter(F.col("user_id").isin(list(user_ids)))


def eligible_players(players: DataFrame, user_ids: UserIds | None = None) -> DataFrame:
    """Distinct (user_id, traffic_type) of eligible players.

    An allow list replaces the cheater rule. A player with two traffic types
    stays twice and doubles the player's attempts.
    """
    if user_ids is None:
        eligible = players.filter(F.col("cheater").isin(list(ELIGIBLE_CHEATER_STATES)))
    else:
        eligible = of_users(players, user_ids)
    return eligible.select("user_id", "traffic_type").distinct()


def finished_events(
    levels: DataFrame,
    event_type: str = FINISHED_EVENT,
    reasons: Iterable[str] = FINISHED_REASONS,
) -> DataFrame:
    """Level-finished events with one of the wanted reasons."""
    return levels.filter(
        (F.col("event_type") == event_type) & F.col("reason").isin(list(reasons))
    )


def without_chain(levels: DataFrame) -> DataFrame:
    """Events outside any chain."""
    return levels.filter(F.col("chain").isNull())


def chain_not_like(levels: DataFrame, pattern: str = EXCLUDED_CHAIN_PATTERN) -> DataFrame:
    """Events whose chain does not match a LIKE pattern; NULL chains are dropped too.

    In the default pattern ``_`` is the one-character wildcard.
    """
    return levels.filter(~F.col("chain").like(pattern))


def after_cutoff(levels: DataFrame, cutoff: DateLike) -> DataFrame:
    """Events strictly after the cutoff, by client time and by partition day."""
    day = F.lit(as_day(cutoff))
    return levels.filter(
        (F.col("client_time") > day.cast("timestamp")) & (F.col("partition_date") > day)
    )


def on_days(rows: DataFrame, days: Limits) -> DataFrame:
    """Rows of the given partition days; a day-partitioned input opens only those."""
    for condition in days.conditions("partition_date", as_day):
        rows = rows.filter(condition)
    return rows


def within_drift(levels: DataFrame, max_seconds: int = MAX_CLOCK_DRIFT_SECONDS) -> DataFrame:
    """Events whose client clock is at most ``max_seconds`` ahead of the server.

    Events that lack either time are dropped; a clock that is behind is fine.
    """
    client, server = (
        F.unix_seconds(F.col(name).cast("timestamp")) for name in ("client_time", "event_time")
    )
    return levels.filter(
        F.col("client_time").isNotNull()
        & F.col("event_time").isNotNull()
        & (client - server <= F.lit(max_seconds))
    )


BROADCAST_BYTES = 200 << 20

# Header, null bits and pointers of a hashed row, generously rounded.
ROW_OVERHEAD_BYTES = 64


def broadcast_if_small(dimension: DataFrame, max_bytes: int) -> DataFrame:
    """The dimension with a broadcast hint if its measured text fits ``max_bytes``.

    Starts one aggregation job over the dimension, which is kept first where the session
    has a shared folder, so that measuring and joining compute it once. A larger dimension
    comes back without a hint: Spark then shuffles both sides, and adaptive execution
    splits the partitions of players with extremely many events.
    """
    if dimension.sparkSession.conf.get("spark.checkpoint.dir", None):
        dimension = keep(dimension)
    widths = [F.octet_length(F.col(name).cast("string")) for name in dimension.columns]
    width = sum((F.coalesce(w, F.lit(0)) for w in widths), start=F.lit(ROW_OVERHEAD_BYTES))
    size = dimension.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(dimension) if size <= max_bytes else dimension


def join_players(
    events: DataFrame, players: DataFrame, broadcast_bytes: int | None = BROADCAST_BYTES
) -> DataFrame:
    """Events of eligible players, with their traffic type.

    The player side is measured up front and broadcast up to ``broadcast_bytes``, which
    spares shuffling the events. With None nothing is measured: Spark chooses the join
    from its size estimates and, at run time, from the measured shuffle sizes.
    """
    side = players if broadcast_bytes is None else broadcast_if_small(players, broadcast_bytes)
    return events.join(side, "user_id", "inner")


def outcome_keys(outcomes: DataFrame) -> list[str]:
    """Attempt key columns the outcome table offers."""
    keys = [name for name in ATTEMPT_KEY if name in outcomes.columns]
    if not keys:
        raise ValueError(f"outcomes need at least one of the columns {', '.join(ATTEMPT_KEY)}")
    return keys


def join_outcomes(attempts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Attempts with the outcome flags of the matching outcome rows, 0 without one.

    Several outcome rows for one key repeat the attempt; NULL keys never match.
    """
    keys, flags = outcome_keys(outcomes), list(OUTCOME_SEGMENTS)
    return attempts.join(outcomes.select(*keys, *flags), keys, "left").fillna(0, subset=flags)


HOT_SHARE = 0.001
SALTS = 256


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that more than a share of all rows have; there are fewer than 1 / share of them.

    Starts one job for the number of rows. Tasks count before the shuffle, so a hot key
    reaches it as one row a task. Rows with a NULL key match nothing and are not counted.
    """
    if not 0 < share < 1:
        raise ValueError("a share lies between 0 and 1")
    least = rows.count() * share
    counts = rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    return counts.filter(F.col("key_rows") > least)


def join_outcomes_spread(
    attempts: DataFrame, outcomes: DataFrame, *, share: float = HOT_SHARE, salts: int = SALTS
) -> DataFrame:
    """``join_outcomes`` for keys that a good part of the attempts have in common.

    The hot keys are measured first. Their attempts are dealt over ``salts`` pieces, each of which
    gets a copy of the key's outcome rows; rows with a NULL key, which match nothing, are dealt
    out as well. All other keys are joined plainly, in the same join. The hot keys are fewer than
    1 / share, so they are broadcast.
    """
    keys, flags = outcome_keys(outcomes), list(OUTCOME_SEGMENTS)
    found = hot_keys(attempts, keys, share)
    if attempts.sparkSession.conf.get("spark.checkpoint.dir", None):
        found = keep(found)
    hot = F.broadcast(found.select(*keys, F.lit(True).alias("_hot")))
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    lost = reduce(operator.or_, [F.col(k).isNull() for k in keys])
    dealt = attempts.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | lost, piece).otherwise(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = outcomes.select(*keys, *flags).join(hot, keys, "left").withColumn("_salt", F.explode(every))
    joined = dealt.drop("_hot").join(copied.drop("_hot"), [*keys, "_salt"], "left")
    return joined.drop("_salt").fillna(0, subset=flags)


def with_flags_segment(attempts: DataFrame) -> DataFrame:
    """Adds ``reason_seg`` from the outcome flags."""
    return attempts.withColumn("reason_seg", flags_segment())


def payload_fields(events: DataFrame, *fields: str, payload: str = "event_payload") -> DataFrame:
    """Adds top-level JSON fields of a payload column as text, in one parse.

    A dot in a field name is part of the name, not a path; the new column has an
    underscore there. Numbers and booleans come out as their JSON text.
    """
    names = [name.replace(".", "_") for name in fields]
    return events.select("*", F.json_tuple(payload, *fields).alias(*names))


def ab_group_names(levels: DataFrame) -> DataFrame:
    """Sorted names of all experiment groups in the ``ab_group`` JSON.

    Arrays contribute their elements, objects their keys; NULL, empty, malformed
    and scalar JSON contribute nothing. Texts are made distinct before parsing.
    """
    texts = levels.select("ab_group").filter(F.col("ab_group") != "").distinct()
    names = F.coalesce(
        F.from_json("ab_group", "array<string>"), F.json_object_keys("ab_group")
    )
    return (
        texts.select(F.explode(names).alias("group_name"))
        .filter(F.col("group_name").isNotNull())
        .distinct()
        .orderBy("group_name")
    )


def player_trajectory(
    attempts: DataFrame, user_ids: UserIds, position: str = "level_cohort"
) -> DataFrame:
    """Chosen players' positions and outcomes in time order.

    ``position`` is ``level_cohort`` or ``balance_id``.
    """
    return (
        of_users(attempts, user_ids)
        .select("user_id", "client_time", position, "reason_seg")
        .orderBy("user_id", "client_time")
    )


def trajectory_steps(attempts: DataFrame, user_ids: UserIds, position: str = "level_cohort") -> DataFrame:
    """Chosen players' positions and outcomes with the number of each step and the position before.

    Steps are numbered by client time; at the same time by position and outcome. The rows come in
    no order of players. On a table that ``write_colocated`` wrote nothing is shuffled.
    """
    steps = Window.partitionBy("user_id").orderBy("client_time", position, "reason_seg")
    rows = of_users(attempts, user_ids).select("user_id", "client_time", position, "reason_seg")
    return rows.withColumns({"step": F.row_number().over(steps), "position_before": F.lag(position).over(steps)})
