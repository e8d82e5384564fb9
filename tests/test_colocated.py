from datetime import date, datetime, timedelta

import pytest
from grid_rows import plan
from pyspark.sql import functions as F

from attempt_grid import COLOCATED_SETTINGS, attempts_from_outcomes, write_colocated
from attempt_grid.operators import mart

RULES = {"bucket_width": 100, "cutoff": "2024-01-05"}


@pytest.fixture
def settings(spark):
    """Sets what the test names and puts the former values back."""
    before = {}

    def use(**values):
        for key, value in values.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield use
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed(spark, n=60_000):
    """Attempts of which a third have one key and a third none, and outcomes of every key."""
    i = F.col("id")
    user = F.when(i % 3 == 0, F.lit("hot")).when(i % 3 == 1, F.concat(F.lit("u"), (i % 5000).cast("string")))
    attempts = spark.range(n, numPartitions=6).select(user.alias("user_id"), (i % 7).cast("int").alias("level"))
    names = spark.range(5000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id")).unionAll(
        spark.createDataFrame([("hot",), ("hot",), (None,)], "user_id string")
    )
    flags = [F.when(F.crc32("user_id") % 4 == k, 1).alias(name) for k, name in enumerate(("FW", "CW", "CF", "FF"))]
    return attempts, names.select("user_id", *flags)


def rows_of(frame):
    return sorted(map(str, frame.groupBy(*sorted(frame.columns)).count().collect()))


def test_spread_join_has_the_rows_of_the_plain_one(spark):
    attempts, outcomes = skewed(spark, 9000)
    plain = mart.join_outcomes(attempts, outcomes)
    for options in ({}, {"salts": 1}, {"share": 0.9}, {"share": 0.5, "salts": 3}):
        found = mart.join_outcomes_spread(attempts, outcomes, **options)
        assert set(found.columns) == set(plain.columns)
        assert rows_of(found) == rows_of(plain)
    assert mart.join_outcomes_spread(attempts.limit(0), outcomes).count() == 0
    assert rows_of(mart.join_outcomes_spread(attempts, outcomes.limit(0))) == rows_of(mart.join_outcomes(attempts, outcomes.limit(0)))


def test_hot_keys_are_those_above_the_share(spark):
    attempts, _ = skewed(spark, 9000)
    assert [tuple(r) for r in mart.hot_keys(attempts, ["user_id"]).collect()] == [("hot", 3000)]
    assert mart.hot_keys(attempts, ["user_id"], 0.4).count() == 0
    with pytest.raises(ValueError):
        mart.hot_keys(attempts, ["user_id"], 0)


def test_no_task_of_the_spread_join_reads_over_three_times_the_median(spark, settings):
    settings(
        spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="16"
    )
    attempts, outcomes = skewed(spark)
    flat = lambda f: sorted(r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect())
    spread = flat(mart.join_outcomes_spread(attempts, outcomes))
    assert len(spread) == 16 and spread[-1] <= 3 * spread[8]
    plain = flat(mart.join_outcomes(attempts, outcomes))
    assert plain[-1] > 3 * plain[len(plain) // 2]


@pytest.fixture(scope="module")
def raw(spark):
    from grid_checks import sample_tables as sample

    sf = "/root/testdata/sf0.001"
    tables = (
        sample.levels_from_events(spark, sf, chained=True),
        sample.players_from_customer(spark, sf),
        sample.outcomes_from_events(spark, sf),
    )
    names = [f"bucketed_{n}" for n in ("levels", "players", "outcomes")]
    for frame, name in zip(tables, names):
        write_colocated(frame, name, 4)
    return tables, [spark.table(name) for name in names]


def test_buckets_are_joined_without_a_shuffle(spark, settings, raw):
    plain, bucketed = raw
    settings(spark__sql__autoBroadcastJoinThreshold="-1", **{k.replace(".", "__"): v for k, v in COLOCATED_SETTINGS.items()})
    built = attempts_from_outcomes(*bucketed, broadcast_bytes=None, **RULES)
    assert "Exchange" not in plan(built) and plan(built).count("Join") == 2
    whole = attempts_from_outcomes(*plain, **RULES)
    assert rows_of(built) == rows_of(whole) != []
    attempts = built.select("user_id", "client_time", "level_cohort", "reason_seg")
    write_colocated(attempts, "bucketed_attempts", 4)
    chosen = bucketed[1].filter(F.col("traffic_type") == "crosspromo")
    steps = mart.trajectory_steps(spark.table("bucketed_attempts"), chosen)
    assert "Exchange" not in plan(steps)
    assert rows_of(steps) == rows_of(mart.trajectory_steps(attempts, chosen))


def test_each_bucket_is_one_file(spark, raw):
    files = spark.table("bucketed_levels").select(F.input_file_name()).distinct().count()
    assert files <= 4
    with pytest.raises(ValueError):
        write_colocated(spark.range(3), "no_buckets", 0, key="id")


def test_steps_follow_client_time(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", t + timedelta(hours=h), level, "far_win") for h, level in ((3, 5), (1, 2), (2, 9), (2, 4))] + [("b", t, 1, "unknown"), ("c", t, 1, "x")]
    frame = spark.createDataFrame(rows, "user_id string, client_time timestamp, level_cohort int, reason_seg string")
    found = sorted((r.user_id, r.step, r.level_cohort, r.position_before) for r in mart.trajectory_steps(frame, ["a", "b"]).collect())
    assert found == [("a", 1, 2, None), ("a", 2, 4, 2), ("a", 3, 9, 4), ("a", 4, 5, 9), ("b", 1, 1, None)]


def test_buckets_within_days(spark):
    rows = [(f"u{i}", date(2026, 1, 1 + i % 2)) for i in range(40)]
    write_colocated(spark.createDataFrame(rows, "user_id string, partition_date date"), "bucketed_days", 3, partition_col="partition_date")
    assert spark.table("bucketed_days").filter("partition_date = '2026-01-02'").count() == 20
