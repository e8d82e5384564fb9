"""Plans and results when one key, cell or day dominates."""

from contextlib import contextmanager
from datetime import date
from pathlib import Path

import pytest
from grid_rows import plan
from pyspark.sql import functions as F

from attempt_grid import GridRequest, aggregate_statistics, filter_options, grid_cells
from attempt_grid.operators import mart
from grid_checks import sample_tables as sample

SF = "/root/testdata/sf0.001"


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}
# Thresholds small enough for the few megabytes of a test to count as skew.
SMALL_SKEW = {
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1m",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1m",
}


@contextmanager
def settings(spark, **values):
    keys = {name.replace("__", "."): value for name, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def hot_events(spark):
    """200,000 events; one player has over a third of them."""
    owner = F.when(F.col("id") % 5 < 2, F.lit(0)).otherwise(F.col("id") % 3000)
    return spark.range(200_000, numPartitions=8).select(
        owner.cast("string").alias("user_id"), "id", F.sha2(F.col("id").cast("string"), 512).alias("payload")
    )


@pytest.fixture
def many_players(spark):
    return spark.range(3000).select(
        F.col("id").cast("string").alias("user_id"),
        F.lit("organic").alias("traffic_type"),
        F.lit("Fair").alias("cheater"),
    )


def test_shuffled_player_join_splits_a_hot_player(spark, hot_events, many_players):
    with settings(spark, **NO_BROADCAST, **SMALL_SKEW):
        joined = mart.join_players(hot_events, mart.eligible_players(many_players), None)
        # The write that follows shuffles by day, so splitting costs no extra shuffle.
        result = joined.repartition(4, "id").agg(F.count("*"), F.sum("id"), F.max("payload").isNotNull())
        (row,) = result.collect()
        final = plan(result)
    assert tuple(row) == (200_000, 200_000 * 199_999 // 2, True)
    assert "SortMergeJoin(skew=true)" in final


def test_outcome_join_splits_a_hot_key_and_unmatched_rows(spark, hot_events):
    """Only the player is a key here; over a third of the rows share one."""
    outcomes = spark.range(0, 3000, 2).select(
        F.col("id").cast("string").alias("user_id"),
        F.lit(1).alias("FW"),
        *[F.lit(None).cast("int").alias(flag) for flag in ("CW", "CF", "FF")],
    )
    with settings(spark, **NO_BROADCAST, **SMALL_SKEW):
        joined = mart.join_outcomes(hot_events, outcomes)
        result = joined.repartition(4, "id").agg(
            F.count("*"), F.sum("FW"), F.sum("CW"), F.max("payload").isNotNull()
        )
        (row,) = result.collect()
        final = plan(result)
    matched = sum(1 for n in range(200_000) if n % 5 < 2 or n % 3000 % 2 == 0)
    assert tuple(row) == (200_000, matched, 0, True)
    assert "SortMergeJoin(skew=true)" in final


def test_broadcast_only_below_the_limit(spark, hot_events, many_players):
    players = mart.eligible_players(many_players)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        small = plan(mart.join_players(hot_events, players, 10**6))
        large = plan(mart.join_players(hot_events, players, 10**5))
    assert "BroadcastHashJoin" in small
    assert "SortMergeJoin" in large


@pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")
def test_payloads_are_parsed_before_the_join(spark):
    from attempt_grid import attempts_from_payload

    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(
            attempts_from_payload(
                sample.levels_from_events(spark, SF, chained=False),
                sample.players_from_customer(spark, SF),
                bucket_width=100,
                cutoff="2024-01-05",
                broadcast_bytes=None,
            )
        )
    join, parse = text.index("SortMergeJoin"), text.index("json_tuple")
    assert join < parse
    shuffled = text[join:parse]
    assert "Exchange hashpartitioning(user_id" in shuffled and "payload" not in shuffled.split("json_tuple")[0]


def test_grid_request_is_one_shuffle(spark, attempts):
    from grid_rows import attempt

    text = plan(grid_cells(attempts(attempt()), GridRequest("fail_rate", "relative", 5)))
    assert text.count("Exchange") == 1


def test_hot_cell_shuffles_one_row_per_task(spark):
    rows = spark.range(100_000, numPartitions=8).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7).cast("int").alias("level_cohort"),
        F.lit(date(2026, 1, 1)).alias("partition_date"),
        *[F.lit(1).alias(name) for name in ("FW", "failed", "attempt", "first_attempt")],
        *[F.lit(0).alias(name) for name in ("CW", "CF", "FF")],
    )
    statistics = aggregate_statistics(rows, ordered=False)
    counts = {r["level_group"]: r["attempts_absolute"] for r in statistics.collect()}
    assert sum(counts.values()) == 100_000 and counts[0] > 40_000
    assert "partial_count" in plan(statistics)


def test_options_of_a_dominant_combination(spark):
    rows = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("campaign"), F.col("id") % 100)).otherwise("organic").alias("traffic_type"),
        F.lit("payer").alias("payer_type"),
        F.lit("ios").alias("platform_name"),
        F.lit(1).alias("attempt"),
        F.lit(True).alias("super_ball"),
        (F.col("id") % 9).cast("int").alias("level_cohort"),
        F.lit(date(2026, 1, 1)).alias("partition_date"),
    )
    row = filter_options(rows).first()
    assert len(row["traffic_types"]) == 101 and row["traffic_types"] == sorted(row["traffic_types"])
    assert (row["level_min"], row["level_max"]) == (0, 8)
