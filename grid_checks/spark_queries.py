"""One Spark query per operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.functions.attempts import level_bucket, level_number, segment_flags
from attempt_grid.operators import contract, grid, health, mart, options
from attempt_grid.operators.criteria import (
    FIRST_ATTEMPT,
    REPEAT_ATTEMPTS,
    AttemptCriteria,
    Limits,
    filter_attempts,
    filter_cells,
)
from attempt_grid.operators.metrics import select_metric, select_metric_values
from attempt_grid.operators.segment_runs import merged_segments, read_runs, segment_deltas, write_run
from attempt_grid.operators.statistics import (
    CELL_KEYS,
    aggregate_statistics,
    segment_totals,
    statistics_from_segments,
)
from attempt_grid.operators.status import ProjectTable, dataset_status, latest_partition
from attempt_grid.plans.grid_request import GridRequest, grid_cells, grid_cells_from_segments
from attempt_grid.plans.mart import attempts_from_outcomes, attempts_from_payload, typed
from attempt_grid.sinks.colocated import write_colocated
from attempt_grid.sinks.day_refresh import refresh_days
from attempt_grid.sinks.tables import keep, overwrite_table, shared_folder, write_lookup, write_partitioned
from attempt_grid.sources.attempts import (
    read_attempts_projected,
    read_attempts_sql,
    read_attempts_table,
)
from grid_checks import sample_tables as sample

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUTOFF = "2024-01-05"
BUCKET_WIDTH = 100
# Buckets narrow enough to leave some cells of the lineitem grid empty.
NARROW_WIDTH = 10
REFRESHED_DAY = date(2024, 1, 10)
REFRESHED_DAYS = date(2024, 1, 8), date(2024, 1, 16)
WITHDRAWN_DAY = date(2024, 1, 12)
LOOKED_UP = ("7", "42", "99")
SHOWN = AttemptCriteria(levels=Limits(3, 12), days=Limits("1996-01-01", "1998-06-30"))
SEVERAL_CONDITIONS = AttemptCriteria(levels=Limits(2, 15), days=Limits("1996-01-01", "1998-06-30"), values={"payer_type": ("payer",), "traffic_type": ("1-URGENT", "2-HIGH"), "platform_name": ("O", "F"), "attempt_group": (REPEAT_ATTEMPTS,), "super_ball": (True,)})


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _register(name: str, build: Query) -> None:
    QUERIES[name] = build


def _folder(spark) -> str:
    """A new folder where the session says; a temporary one only where driver and executors are one machine."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local["):
        return shared_folder(spark)
    return f"{tempfile.mkdtemp(prefix='grid-checks-')}/kept"


@contextmanager
def _database(spark):
    """The name of a database in a new shared folder, dropped with its tables afterwards."""
    name = f"grid_checks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{_folder(spark)}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _kept(frame: DataFrame) -> DataFrame:
    return keep(frame, _folder(frame.sparkSession))


# --- sources, contract, sinks ------------------------------------------------


@_query
def scan_table(spark, sf_dir):
    sample.attempts_from_events(spark, sf_dir).createOrReplaceTempView("event_attempts")
    return read_attempts_table(spark, "event_attempts")


@_query
def scan_sql(spark, sf_dir):
    sample.attempts_from_events(spark, sf_dir).createOrReplaceTempView("event_attempts")
    return read_attempts_sql(spark, "SELECT *, 1 AS surplus FROM event_attempts")


@_query
def scan_projected(spark, sf_dir):
    attempts = sample.attempts_from_lineitem(spark, sf_dir)
    attempts.withColumn("surplus", F.lit(1)).createOrReplaceTempView("lineitem_attempts")
    return read_attempts_projected(spark, "lineitem_attempts")


@_query
def contract_project(spark, sf_dir):
    return contract.to_contract(sample.text_attempts(spark, sf_dir))


@_query
def contract_rejects(spark, sf_dir):
    rejects = contract.contract_rejects(sample.text_attempts(spark, sf_dir))
    return rejects.withColumn("reject_reasons", F.array_join("reject_reasons", "; "))


@_query
def contract_accepted(spark, sf_dir):
    folder = _folder(spark)
    contract.write_checked(sample.text_attempts(spark, sf_dir), folder)
    return contract.read_accepted(spark, folder)


@_query
def contract_split_rejects(spark, sf_dir):
    folder = _folder(spark)
    contract.write_checked(sample.text_attempts(spark, sf_dir), folder)
    rejects = contract.read_rejected(spark, folder)
    return rejects.withColumn("reject_reasons", F.array_join("reject_reasons", "; "))


@_query
def contract_sorted(spark, sf_dir):
    return contract.canonical_sort(sample.attempts_from_events(spark, sf_dir))


@_query
def sink_roundtrip(spark, sf_dir):
    folder = _folder(spark)
    write_partitioned(sample.attempts_from_events(spark, sf_dir), folder)
    return spark.read.parquet(folder).select(*contract.ATTEMPT_COLUMNS)


# --- attempt table build -----------------------------------------------------


def _levels(spark, sf_dir, chained=False):
    return sample.levels_from_events(spark, sf_dir, chained=chained)


def _plain(levels: DataFrame) -> DataFrame:
    """Raw event columns without the JSON texts."""
    return levels.select("user_id", "client_time", "event_type", "reason", "chain")


@_query
def mart_eligible_users(spark, sf_dir):
    return mart.eligible_players(sample.players_from_customer(spark, sf_dir))


@_query
def mart_event_filter(spark, sf_dir):
    return _plain(mart.finished_events(_levels(spark, sf_dir)))


@_query
def mart_chain_not_like(spark, sf_dir):
    return _plain(mart.chain_not_like(_levels(spark, sf_dir, chained=True)))


@_query
def mart_cutoff(spark, sf_dir):
    return _plain(mart.after_cutoff(_levels(spark, sf_dir), CUTOFF))


@_query
def mart_drift_filter(spark, sf_dir):
    return mart.within_drift(_levels(spark, sf_dir)).select("user_id", "client_time", "event_time")


@_query
def mart_user_join(spark, sf_dir):
    players = mart.eligible_players(sample.players_from_customer(spark, sf_dir))
    events = _levels(spark, sf_dir).select("user_id", "client_time", "reason")
    return mart.join_players(events, players)


@_query
def mart_level_id(spark, sf_dir):
    events = mart.payload_fields(_levels(spark, sf_dir), "balance_id")
    return events.select(
        "user_id",
        "client_time",
        F.col("balance_id").alias("level_id"),
        level_number(F.col("balance_id")).alias("balance_id"),
    )


@_query
def mart_json_fields(spark, sf_dir):
    events = _levels(spark, sf_dir).drop("attempt")
    events = mart.payload_fields(events, "reason_seg", "attempt", "super_ball")
    events = mart.payload_fields(events, "tech.platform_name", payload="user_payload")
    return events.select(
        "user_id",
        "client_time",
        "reason_seg",
        "attempt",
        "super_ball",
        F.col("tech_platform_name").alias("platform_name"),
    )


@_query
def mart_level_bucket(spark, sf_dir):
    parts = sample.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") - 50).cast("int").alias("balance_id")
    )
    return parts.withColumn("level_cohort", level_bucket(F.col("balance_id"), 75))


@_query
def mart_outcome_flags(spark, sf_dir):
    attempts = sample.attempts_from_lineitem(spark, sf_dir).select(
        "user_id", "client_time", "reason_seg"
    )
    return attempts.withColumns(segment_flags(F.col("reason_seg")))


def _keyed_events(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    return sample.events(spark, sf_dir).select(
        F.col("ts").alias("client_time"),
        F.when(~k.isin(13, 14), k * 10).alias("balance_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.to_date("ts").alias("partition_date"),
        "event_type",
    )


@_query
def mart_outcome_join(spark, sf_dir):
    return mart.join_outcomes(_keyed_events(spark, sf_dir), sample.outcomes_from_events(spark, sf_dir))


@_query
def mart_outcome_join_spread(spark, sf_dir):
    """Outcomes of a player's levels, whatever the time: keys that many attempts have in common."""
    outcomes = sample.outcomes_from_events(spark, sf_dir)
    by_level = outcomes.groupBy("balance_id").agg(*[F.max(c).alias(c) for c in ("FW", "CW", "CF", "FF")])
    return mart.join_outcomes_spread(_keyed_events(spark, sf_dir), by_level, share=0.005)


@_query
def mart_flags_to_segment(spark, sf_dir):
    attempts = sample.attempts_from_lineitem(spark, sf_dir).select(
        "user_id", "client_time", "balance_id", "FW", "CW", "CF", "FF"
    )
    return mart.with_flags_segment(attempts)


@_query
def mart_a(spark, sf_dir):
    return attempts_from_payload(
        _levels(spark, sf_dir),
        sample.players_from_customer(spark, sf_dir),
        bucket_width=BUCKET_WIDTH,
        cutoff=CUTOFF,
    )


@_query
def mart_b(spark, sf_dir):
    return attempts_from_outcomes(
        _levels(spark, sf_dir, chained=True),
        sample.players_from_customer(spark, sf_dir),
        sample.outcomes_from_events(spark, sf_dir),
        bucket_width=BUCKET_WIDTH,
        cutoff=CUTOFF,
    )


@_query
def mart_b_colocated(spark, sf_dir):
    """The build with joined outcomes from tables in buckets by player."""
    tables = {
        "levels": _levels(spark, sf_dir, chained=True),
        "players": sample.players_from_customer(spark, sf_dir),
        "outcomes": sample.outcomes_from_events(spark, sf_dir),
    }
    with _database(spark) as name:
        for table, rows in tables.items():
            write_colocated(rows, f"{name}.{table}", 8)
        stored = [spark.table(f"{name}.{table}") for table in tables]
        return _kept(attempts_from_outcomes(*stored, bucket_width=BUCKET_WIDTH, cutoff=CUTOFF, broadcast_bytes=None))


@_query
def refresh_one_day(spark, sf_dir):
    """The whole table after one day, of which rows were missing, was built again."""
    levels, players = _levels(spark, sf_dir), sample.players_from_customer(spark, sf_dir)
    rules = {"bucket_width": BUCKET_WIDTH, "cutoff": CUTOFF}
    folder, day = _folder(spark), F.col("partition_date") == F.lit(REFRESHED_DAY)
    stale = typed(attempts_from_payload(levels, players, **rules)).filter(~day | (F.col("failed") == 1))
    write_partitioned(stale, folder)
    days = Limits(REFRESHED_DAY, REFRESHED_DAY)
    fresh = typed(attempts_from_payload(levels, players, days=days, **rules))
    write_partitioned(fresh, folder, only_present_days=True)
    return spark.read.schema(fresh.schema).parquet(folder)


@_query
def refresh_withdrawn_days(spark, sf_dir):
    """A stored table without super_ball after a refresh of some days, one of which has no rows any more."""
    levels, players = _levels(spark, sf_dir), sample.players_from_customer(spark, sf_dir)
    built = keep(typed(attempts_from_payload(levels, players, bucket_width=BUCKET_WIDTH, cutoff=CUTOFF)), _folder(spark))
    with _database(spark) as name:
        overwrite_table(built.drop("super_ball"), f"{name}.attempts")
        fresh = built.filter(F.col("partition_date").between(*REFRESHED_DAYS) & (F.col("partition_date") != WITHDRAWN_DAY))
        refresh_days(fresh, f"{name}.attempts", Limits(*REFRESHED_DAYS))
        return _kept(spark.table(f"{name}.attempts"))


@_query
def ab_group_names(spark, sf_dir):
    return mart.ab_group_names(_levels(spark, sf_dir))


@_query
def player_trajectory(spark, sf_dir):
    players = sample.players_from_customer(spark, sf_dir)
    chosen = players.filter(F.col("traffic_type") == "crosspromo")
    return mart.player_trajectory(mart_a(spark, sf_dir), chosen)


@_query
def trajectory_steps(spark, sf_dir):
    players = sample.players_from_customer(spark, sf_dir)
    chosen = players.filter(F.col("traffic_type") == "crosspromo")
    return mart.trajectory_steps(mart_a(spark, sf_dir), chosen)


@_query
def player_lookup(spark, sf_dir):
    """The trajectory of single players from files with filters on the player."""
    folder = _folder(spark)
    write_lookup(mart_a(spark, sf_dir), folder)
    return mart.player_trajectory(spark.read.parquet(folder), LOOKED_UP, "balance_id")


# --- filters and options -----------------------------------------------------


def _filtered(criteria: AttemptCriteria) -> Query:
    return lambda spark, sf_dir: filter_attempts(
        sample.attempts_from_events(spark, sf_dir), criteria
    )


_register("filter_level_range", _filtered(AttemptCriteria(levels=Limits(2, 5))))
_register(
    "filter_date_range",
    _filtered(AttemptCriteria(days=Limits("2024-01-10", date(2024, 1, 20)))),
)
_register("filter_payer", _filtered(AttemptCriteria(values={"payer_type": ("payer",)})))
_register("filter_traffic", _filtered(AttemptCriteria(values={"traffic_type": ("BUILDING", "MACHINERY")})))
_register("filter_platform", _filtered(AttemptCriteria(values={"platform_name": ("ios",)})))
_register("filter_attempt_group", _filtered(AttemptCriteria(values={"attempt_group": (FIRST_ATTEMPT,)})))
_register("filter_super_ball", _filtered(AttemptCriteria(values={"super_ball": (False,)})))


@_query
def filter_combined(spark, sf_dir):
    return filter_attempts(sample.attempts_from_lineitem(spark, sf_dir), SEVERAL_CONDITIONS)


@_query
def filter_quote_literal(spark, sf_dir):
    attempts = sample.attempts_from_events(spark, sf_dir).withColumn(
        "payer_type",
        F.when(F.col("super_ball"), F.concat("payer_type", F.lit("'s cohort"))).otherwise(
            F.col("payer_type")
        ),
    )
    return filter_attempts(attempts, AttemptCriteria(values={"payer_type": ("payer", "payer's cohort")}))


@_query
def options_bounds(spark, sf_dir):
    return options.bounds(sample.attempts_from_lineitem(spark, sf_dir))


@_query
def options_distinct(spark, sf_dir):
    return options.distinct_values(sample.attempts_from_events(spark, sf_dir), "traffic_type")


@_query
def options_attempt_groups(spark, sf_dir):
    groups = options.attempt_group_presence(sample.attempts_from_lineitem(spark, sf_dir))
    return groups.select(F.array_join("attempt_groups", ",").alias("attempt_groups"))


@_query
def options_super_ball(spark, sf_dir):
    values = options.super_ball_presence(sample.attempts_from_events(spark, sf_dir))
    return values.select(_joined("super_ball_values"))


@_query
def options_offered(spark, sf_dir):
    offered = options.offered_values(sample.attempts_from_lineitem(spark, sf_dir), ["payer_type", "traffic_type", "balance_id"], most=6)
    few = F.col("is_complete")
    return offered.select(
        "column", "is_complete", *(F.when(few, F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in ("values", "counts"))
    )


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


@_query
def options_one_pass(spark, sf_dir):
    return _flat_options(options.filter_options(sample.attempts_from_lineitem(spark, sf_dir)))


def _flat_options(found: DataFrame) -> DataFrame:
    """The option row with each list as comma-separated text."""
    lists = [f.name for f in found.schema if f.dataType.typeName() == "array"]
    plain = [name for name in found.columns if name not in lists]
    return found.select(*plain, *map(_joined, lists))


# --- statistics and metrics --------------------------------------------------


def _statistics(spark, sf_dir, criteria=None):
    return aggregate_statistics(
        sample.attempts_from_lineitem(spark, sf_dir), criteria, ordered=False
    )


def _some_statistics(*names: str) -> Query:
    return lambda spark, sf_dir: _statistics(spark, sf_dir).select(*CELL_KEYS, *names)


@_query
def stats_all(spark, sf_dir):
    return aggregate_statistics(sample.attempts_from_lineitem(spark, sf_dir))


_register(
    "stats_outcomes",
    _some_statistics(
        "FW_absolute",
        "CW_absolute",
        "CF_absolute",
        "FF_absolute",
        "wins_absolute",
        "fails_absolute",
    ),
)
_register(
    "stats_counts",
    _some_statistics(
        "attempts_absolute", "failed_absolute", "attempt_average", "first_attempt_absolute"
    ),
)
_register(
    "stats_relative", _some_statistics("FW_relative", "CW_relative", "CF_relative", "FF_relative")
)
_register(
    "stats_partial_relative",
    _some_statistics(
        "FW_partial_relative", "CW_partial_relative", "FF_partial_relative", "CF_partial_relative"
    ),
)
_register(
    "stats_rates",
    _some_statistics("fail_rate_relative", "win_rate_relative", "first_attempt_relative"),
)


@_query
def stats_filtered(spark, sf_dir):
    return _statistics(spark, sf_dir, SEVERAL_CONDITIONS)


@_query
def stats_from_segments(spark, sf_dir):
    segments = segment_totals(sample.attempts_from_lineitem(spark, sf_dir))
    return statistics_from_segments(segments, SEVERAL_CONDITIONS)


@_query
def options_from_segments(spark, sf_dir):
    segments = segment_totals(sample.attempts_from_lineitem(spark, sf_dir))
    return _flat_options(options.segment_options(segments))


@_query
def metric_values(spark, sf_dir):
    return select_metric_values(_statistics(spark, sf_dir), "attempt", "average")


@_query
def metric_context(spark, sf_dir):
    return select_metric(_statistics(spark, sf_dir), "CF", "partial_relative", min_observations=12)


@_query
def metric_low_sample(spark, sf_dir):
    return select_metric(_statistics(spark, sf_dir), "win_rate", "relative", min_observations=30)


@_query
def display_filter(spark, sf_dir):
    return filter_cells(_statistics(spark, sf_dir), SHOWN)


@_query
def display_filter_equiv(spark, sf_dir):
    return _statistics(spark, sf_dir, SHOWN)


@_query
def stats_reuse(spark, sf_dir):
    statistics = _kept(_statistics(spark, sf_dir))
    fail_rate = select_metric(statistics, "fail_rate", "relative", min_observations=30)
    wins = select_metric(filter_cells(statistics, SHOWN), "wins", "absolute")
    return fail_rate.unionByName(wins)


# --- grid --------------------------------------------------------------------


def _narrow_values(spark, sf_dir):
    """Failure shares in narrow level buckets, kept: the grids below read them more than once."""
    attempts = sample.attempts_from_lineitem(spark, sf_dir)
    narrow = attempts.withColumn("level_cohort", level_bucket(F.col("balance_id"), NARROW_WIDTH))
    statistics = aggregate_statistics(narrow, ordered=False)
    return _kept(select_metric(statistics, "fail_rate", "relative", min_observations=3))


@_query
def grid_duplicates(spark, sf_dir):
    attempts = sample.attempts_from_lineitem(spark, sf_dir)
    cells = attempts.withColumnsRenamed({"level_cohort": "level_group", "partition_date": "date"})
    return grid.duplicate_cells(cells)


@_query
def grid_pivot(spark, sf_dir):
    return grid.pivot_grid(_narrow_values(spark, sf_dir), sample.MONTHS)


@_query
def grid_records(spark, sf_dir):
    return grid.grid_records(grid.pivot_grid(_narrow_values(spark, sf_dir)))


@_query
def grid_block_records(spark, sf_dir):
    return grid.block_records(grid.grid_blocks(_narrow_values(spark, sf_dir)))


@_query
def grid_dense(spark, sf_dir):
    return grid.dense_grid(_narrow_values(spark, sf_dir))


def _dense_on_days(spark, sf_dir):
    values = _narrow_values(spark, sf_dir)
    return grid.dense_grid(values, grid.grid_days(values))


@_query
def grid_masked(spark, sf_dir):
    return grid.mask_low_samples(_dense_on_days(spark, sf_dir))


@_query
def grid_bounds(spark, sf_dir):
    return grid.value_bounds(grid.mask_low_samples(_narrow_values(spark, sf_dir)))


@_query
def grid_cell_details(spark, sf_dir):
    cells = _dense_on_days(spark, sf_dir)
    return grid.cell_details(cells).select(*CELL_KEYS, "detail.*")


@_query
def grid_clamped(spark, sf_dir):
    statistics = _kept(_statistics(spark, sf_dir))
    values = select_metric(statistics, "win_rate", "relative", min_observations=30)
    clamped = grid.clamp_values(grid.mask_low_samples(values), (75.0, 60.0))
    return clamped.select(*CELL_KEYS, "value", "visible_value", "color_value", "color_position")


@_query
def grid_request(spark, sf_dir):
    """Where on the grid do players fail most, and is the sample large enough?"""
    request = GridRequest("fail_rate", "relative", min_observations=30)
    return grid_cells(sample.attempts_from_events(spark, sf_dir), request)


@_query
def grid_from_segments(spark, sf_dir):
    request = GridRequest("fail_rate", "relative", min_observations=30)
    segments = _kept(segment_totals(sample.attempts_from_events(spark, sf_dir)))
    return grid_cells_from_segments(segments, request)


@_query
def grid_from_runs(spark, sf_dir):
    """The same from runs of signed deltas: late rows, a repeated run, and level bucket 4 withdrawn."""
    attempts = sample.attempts_from_events(spark, sf_dir)
    late, odd = F.col("balance_id") % 3 == 0, F.col("attempt") == 2
    folder = _folder(spark)
    write_run(segment_deltas(attempts.filter(~late)), folder, "run-1")
    write_run(segment_deltas(attempts.filter(late & odd)), folder, "run-2")
    write_run(segment_deltas(attempts.filter(late)), folder, "run-2")
    write_run(segment_deltas(withdrawn=attempts.filter("level_cohort = 4")), folder, "run-3")
    request = GridRequest("fail_rate", "relative", min_observations=30)
    return grid_cells_from_segments(merged_segments(read_runs(spark, folder)), request)


# --- status and health -------------------------------------------------------


_register(
    "latest_partition",
    lambda spark, sf_dir: latest_partition(sample.attempts_from_events(spark, sf_dir)),
)


def _status(spark, sf_dir):
    sample.attempts_from_events(spark, sf_dir).createOrReplaceTempView("event_attempts")
    sample.attempts_from_lineitem(spark, sf_dir).createOrReplaceTempView("lineitem_attempts")
    return dataset_status(
        spark,
        [
            ProjectTable("events", "event_attempts", True),
            ProjectTable("lineitem", "lineitem_attempts"),
            ProjectTable("missing", "no_such_attempts"),
        ],
    )


_register("dataset_status", _status)


@_query
def mart_health_days(spark, sf_dir):
    # Attempts of a month are dated to its first day, so the days between are gaps.
    return health.attempts_per_calendar_day(sample.attempts_from_lineitem(spark, sf_dir))


@_query
def mart_health_gaps(spark, sf_dir):
    return health.day_gaps(sample.attempts_with_stray_days(spark, sf_dir))


@_query
def mart_health_runs(spark, sf_dir):
    return health.day_runs(sample.attempts_with_stray_days(spark, sf_dir))


@_query
def mart_health_cohorts(spark, sf_dir):
    return health.attempts_per_bucket(mart_a(spark, sf_dir))


@_query
def mart_health_nulls(spark, sf_dir):
    return health.missing_values(mart_b(spark, sf_dir))
