from datetime import date, datetime, timedelta

import pytest
from grid_rows import plan
from pyspark.sql import functions as F

from attempt_grid import (
    ProjectBuild,
    attempts_from_outcomes,
    attempts_from_payload,
    rebuild_table,
    refresh,
    to_contract,
)
from attempt_grid.functions.attempts import is_first_attempt, level_bucket, level_number
from attempt_grid.operators import mart
from attempt_grid.plans.mart import OUTCOME_BUILD_COLUMNS, PAYLOAD_BUILD_COLUMNS, typed
from attempt_grid.sinks.tables import arranged

LEVELS = (
    "user_id string, client_time timestamp, event_time timestamp, partition_date date,"
    " event_type string, reason string, chain string, payer_type string, ab_group string,"
    " attempt string, event_payload string, user_payload string"
)
NOON = datetime(2026, 1, 10, 12)


def event(**changes):
    row = {
        "user_id": "u1",
        "client_time": NOON,
        "event_time": NOON,
        "partition_date": date(2026, 1, 10),
        "event_type": "m3.level_finished",
        "reason": "completed",
        "chain": None,
        "payer_type": "payer",
        "ab_group": None,
        "attempt": "1",
        "event_payload": '{"balance_id":"st00120","reason_seg":"far_win","attempt":"1","super_ball":true}',
        "user_payload": '{"tech.platform_name":"ios"}',
    }
    return {**row, **changes}


@pytest.fixture
def levels(spark):
    def build(*rows):
        return spark.createDataFrame([tuple(r.values()) for r in rows], LEVELS)

    return build


@pytest.fixture
def players(spark):
    return spark.createDataFrame(
        [
            ("u1", "organic", "Fair"),
            ("u1", "organic", "Fair"),
            ("u2", "paid", "Soft"),
            ("u2", "incent", "Fair"),
            ("u3", "paid", "Cheater"),
            ("u4", "paid", None),
        ],
        "user_id string, traffic_type string, cheater string",
    )


def from_payload(levels, players, **options):
    return attempts_from_payload(levels, players, bucket_width=100, cutoff="2026-01-01", **options)


def test_eligible_players(players):
    rows = {tuple(r) for r in mart.eligible_players(players).collect()}
    assert rows == {("u1", "organic"), ("u2", "paid"), ("u2", "incent")}
    listed = {tuple(r) for r in mart.eligible_players(players, ["u3", "u1"]).collect()}
    assert listed == {("u3", "paid"), ("u1", "organic")}
    assert mart.eligible_players(players, []).count() == 0


def test_event_filters(levels):
    frame = levels(
        event(),
        event(event_type="m3.level_started"),
        event(reason="aborted"),
        event(reason=None),
        event(reason="failed"),
    )
    assert [r["reason"] for r in mart.finished_events(frame).collect()] == ["completed", "failed"]


def test_chain_rules(levels):
    frame = levels(*[event(chain=c) for c in (None, "WL_1", "WLX1", "WL", "main")])
    assert [r["chain"] for r in mart.without_chain(frame).collect()] == [None]
    # '_' is a wildcard, and NULL does not satisfy NOT LIKE.
    assert sorted(r["chain"] for r in mart.chain_not_like(frame).collect()) == ["WL", "main"]


def test_cutoff_excludes_its_own_day(levels):
    frame = levels(
        event(client_time=datetime(2026, 1, 1, 8), partition_date=date(2026, 1, 1)),
        event(client_time=datetime(2026, 1, 1), partition_date=date(2026, 1, 2)),
        event(client_time=datetime(2026, 1, 1, 0, 0, 1), partition_date=date(2026, 1, 2)),
        event(client_time=None),
    )
    kept = mart.after_cutoff(frame, "2026-01-01").collect()
    assert [r["client_time"] for r in kept] == [datetime(2026, 1, 1, 0, 0, 1)]


def test_clock_drift(levels):
    ahead = [timedelta(days=3), timedelta(days=3, milliseconds=900), timedelta(days=3, seconds=1), -timedelta(days=90)]
    frame = levels(
        *[event(event_time=NOON - d, reason=str(n)) for n, d in enumerate(ahead)],
        event(event_time=None),
        event(client_time=None),
    )
    kept = {r["reason"] for r in mart.within_drift(frame).collect()}
    # 3 days and 0.9 s span 3 days and 1 s in whole seconds: 12:00:00 - 11:59:59.
    assert kept == {"0", "3"}


def test_player_join_repeats_and_drops(levels, players):
    frame = levels(event(), event(user_id="u2"), event(user_id="u3"), event(user_id=None))
    for limit in (None, 0, 10**9):
        joined = mart.join_players(frame, mart.eligible_players(players), limit)
        found = sorted((r["user_id"], r["traffic_type"]) for r in joined.collect())
        assert found == [("u1", "organic"), ("u2", "incent"), ("u2", "paid")]


@pytest.mark.parametrize(
    ("text", "number"),
    [("st00120", 120), ("st000", 0), ("st7", 7), ("x", None), ("", None), (None, None), ("st99999999999", None)],
)
def test_level_number(spark, text, number):
    frame = spark.createDataFrame([(text,)], "id string")
    assert frame.select(level_number(F.col("id"))).first()[0] == number


@pytest.mark.parametrize(("level", "bucket"), [(0, 0), (99, 0), (100, 1), (-1, -1), (None, None)])
def test_level_bucket(spark, level, bucket):
    frame = spark.createDataFrame([(level,)], "n int").select(level_bucket(F.col("n"), 100).alias("b"))
    assert frame.schema["b"].dataType.typeName() == "integer"
    assert frame.first()["b"] == bucket


def test_level_bucket_width(spark):
    frame = spark.createDataFrame([(7,)], "n int")
    assert frame.select(level_bucket(F.col("n"), 2.5)).first()[0] == 2
    with pytest.raises(ValueError, match="positive"):
        level_bucket(F.col("n"), 0)


@pytest.mark.parametrize(("text", "flag"), [("1", 1), (" 1", 1), ("2", 0), ("abc", 0), (None, 0), ("1.0", 1), ("1e0", 1), ("1.9", 1), ("2.9", 0)])
def test_first_attempt(spark, text, flag):
    frame = spark.createDataFrame([(text,)], "a string")
    assert frame.select(is_first_attempt(F.col("a"), frame.schema["a"].dataType)).first()[0] == flag


def test_payload_build(levels, players):
    frame = levels(
        event(),
        event(
            user_id="u2", reason="failed",
            event_payload='{"balance_id":"st00099","reason_seg":"far_fail","attempt":"2"}',
            user_payload='{"tech":{"platform_name":"ios"}}',
        ),
        event(event_payload='{"balance_id":"x","attempt":"abc","super_ball":"no"}'),
        event(event_payload="broken", user_payload=None),
        event(chain="main"),
        event(user_id="u3"),
    )
    result = from_payload(frame, players)
    assert result.columns == list(PAYLOAD_BUILD_COLUMNS)
    rows = sorted(result.collect(), key=lambda r: (r["user_id"], str(r["balance_id"]), r["traffic_type"], str(r["attempt"])))
    good, broken, odd, incent, paid = rows
    assert (good["balance_id"], good["level_cohort"], good["failed"], good["reason_seg"]) == (120, 1, 0, "far_win")
    assert (good["attempt"], good["super_ball"], good["platform_name"]) == ("1", "true", "ios")
    assert (good["first_attempt"], good["FW"], good["CW"], good["CF"], good["FF"]) == (1, 1, 0, 0, 0)
    for row in (broken, odd):
        assert (row["balance_id"], row["level_cohort"], row["reason_seg"]) == (None, None, "unknown")
        assert row["FW"] + row["CW"] + row["CF"] + row["FF"] == row["first_attempt"] == 0
    assert {broken["attempt"], odd["attempt"]} == {None, "abc"}
    assert (incent["traffic_type"], paid["traffic_type"]) == ("incent", "paid")
    assert (paid["failed"], paid["FF"], paid["level_cohort"], paid["platform_name"]) == (1, 1, 0, None)


def test_payload_build_for_listed_players(levels, players):
    frame = levels(event(), event(user_id="u3"), event(user_id="u2"))
    result = from_payload(frame, players, user_ids=["u3"])
    assert [r["user_id"] for r in result.collect()] == ["u3"]


def test_listed_players_filter_the_event_scan(spark, levels, players, tmp_path):
    levels(event()).write.parquet(str(tmp_path / "levels"))
    stored = spark.read.parquet(str(tmp_path / "levels"))
    text = plan(from_payload(stored, players, user_ids=["u1", "u2"]))
    assert "In(user_id, [u1,u2])" in text


def outcome_table(spark, *rows, schema=None):
    return spark.createDataFrame(
        list(rows),
        schema or "client_time timestamp, balance_id int, user_id string, partition_date date,"
        " FW int, CW int, CF int, FF int",
    )


def test_outcome_build(spark, levels, players):
    day = date(2026, 1, 10)
    frame = levels(
        event(chain="main", ab_group='["a"]'),
        event(chain="main", client_time=NOON + timedelta(hours=1), reason="failed", attempt="2"),
        event(chain="main", event_payload='{"balance_id":"x"}', attempt="abc"),
        event(),
        event(chain="WLX1"),
        event(chain="main", event_time=NOON - timedelta(days=4)),
    )
    outcomes = outcome_table(
        spark,
        (NOON, 120, "u1", day, None, 1, None, None),
        (NOON, 120, "u1", day, 1, 1, None, None),
        (NOON, None, "u1", day, 1, None, None, None),
    )
    result = attempts_from_outcomes(frame, players, outcomes, bucket_width=100, cutoff="2026-01-01")
    assert result.columns == list(OUTCOME_BUILD_COLUMNS)
    rows = result.collect()
    # The first attempt has two outcome rows, the second and the unreadable level have none.
    segments = sorted((str(r["balance_id"]), r["client_time"].hour, r["reason_seg"]) for r in rows)
    assert segments == [
        ("120", 12, "close_win"),
        ("120", 12, "far_win"),
        ("120", 13, "unknown"),
        ("None", 12, "unknown"),
    ]
    for row in rows:
        assert None not in (row["FW"], row["CW"], row["CF"], row["FF"])
    late = next(r for r in rows if r["client_time"].hour == 13)
    assert (late["failed"], late["attempt"], late["first_attempt"], late["super_ball"]) == (1, 2, 0, "true")
    unreadable = next(r for r in rows if r["balance_id"] is None)
    assert (unreadable["attempt"], unreadable["first_attempt"]) == (None, 0)


def test_outcomes_join_on_the_keys_they_have(spark):
    attempts = spark.createDataFrame([("u1", 1), ("u2", 2)], "user_id string, balance_id int")
    outcomes = spark.createDataFrame([("u1", 1, 0, 0, 0)], "user_id string, FW int, CW int, CF int, FF int")
    assert mart.outcome_keys(outcomes) == ["user_id"]
    rows = {r["user_id"]: r["FW"] for r in mart.join_outcomes(attempts, outcomes).collect()}
    assert rows == {"u1": 1, "u2": 0}
    with pytest.raises(ValueError, match="at least one of the columns"):
        mart.join_outcomes(attempts, outcomes.drop("user_id"))


def test_ab_group_names(levels):
    texts = ['["b","a"]', '{"c":{"x":1},"a":null}', "", None, "broken", '"scalar"', "5", "[]", "{}", "[null]"]
    frame = levels(*[event(ab_group=t) for t in texts])
    assert [r["group_name"] for r in mart.ab_group_names(frame).collect()] == ["a", "b", "c"]


def test_player_trajectory(levels, players):
    frame = levels(
        event(client_time=NOON + timedelta(hours=2)), event(user_id="u2"), event(), event(user_id="u3")
    )
    built = from_payload(frame, players)
    rows = mart.player_trajectory(built, ["u1"]).collect()
    assert [(r["client_time"].hour, r["level_cohort"], r["reason_seg"]) for r in rows] == [
        (12, 1, "far_win"),
        (14, 1, "far_win"),
    ]
    assert "balance_id" in mart.player_trajectory(built, ["u1"], "balance_id").columns
    listed = players.filter("user_id = 'u1'")
    assert mart.player_trajectory(built, listed).collect() == rows
    assert mart.eligible_players(players, listed).collect() == [("u1", "organic")]


def test_rebuilt_table_is_typed_and_reads_as_contract(spark, levels, players):
    built = from_payload(levels(event(), event(event_payload='{"balance_id":"st1","attempt":"2.0","super_ball":"no"}')), players)
    assert typed(built).schema["attempt"].dataType.typeName() == "integer"
    rebuild_table(built, "rebuilt_attempts")
    stored = spark.table("rebuilt_attempts")
    assert stored.schema["super_ball"].dataType.typeName() == "boolean"
    rows = to_contract(stored, trim_text=False).orderBy("balance_id").collect()
    assert [(r["balance_id"], r["attempt"], r["super_ball"]) for r in rows] == [(1, 2, False), (120, 1, True)]


def test_refresh_builds_only_what_is_requested(spark, levels, players):
    built = from_payload(levels(event(), event(partition_date=date(2026, 1, 12))), players)

    def never():
        raise AssertionError("not requested")

    status = refresh(
        spark,
        [
            ProjectBuild("first", "refresh_first", lambda: built, requested=True, cluster=False),
            ProjectBuild("second", "refresh_second", never),
        ],
    )
    assert [tuple(r) for r in status.collect()] == [
        ("first", "refresh_first", True, "2026-01-12"),
        ("second", "refresh_second", False, "недоступно: AnalysisException"),
    ]
    again = refresh(spark, [ProjectBuild("first", "refresh_first", never)])
    assert again.first()["latest_partition"] == "2026-01-12"


@pytest.fixture
def stored_levels(spark, levels, tmp_path):
    path = str(tmp_path / "levels")
    levels(event(), event(chain="main")).write.partitionBy("partition_date").parquet(path)
    return spark.read.parquet(path)


def event_scan(text):
    return next(line for line in text.splitlines() if "FileScan" in line and "event_payload" in line)


def test_payload_build_prunes_its_event_scan(stored_levels, players):
    scan = event_scan(plan(from_payload(stored_levels, players)))
    assert "partition_date" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    for pushed in ("EqualTo(event_type,m3.level_finished)", "In(reason, [completed,failed])",
                   "IsNull(chain)", "GreaterThan(client_time", "IsNotNull(user_id)"):
        assert pushed in scan
    columns = scan.split("ReadSchema")[1]
    assert "ab_group" not in columns and "event_time" not in columns and ",attempt:" not in columns


def test_outcome_build_prunes_its_event_scan(spark, stored_levels, players):
    outcomes = outcome_table(spark, (NOON, 1, "u1", date(2026, 1, 10), 1, 0, 0, 0))
    built = attempts_from_outcomes(stored_levels, players, outcomes, bucket_width=100, cutoff="2026-01-01")
    scan = event_scan(plan(built))
    assert "partition_date" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    for pushed in ("EqualTo(event_type,m3.level_finished)", "In(reason, [completed,failed])",
                   "IsNotNull(event_time)", "IsNotNull(chain)", "GreaterThan(client_time"):
        assert pushed in scan


def test_broadcast_build_over_days_does_not_shuffle_events(stored_levels, players):
    built = typed(from_payload(stored_levels, players, broadcast_bytes=10**6))
    text = plan(arranged(built, "partition_date", cluster=False))
    events = text[: text.index("BroadcastExchange")]
    assert "Exchange" not in events
    # Clustering by day is the one shuffle it can have.
    clustered = plan(arranged(built, "partition_date", cluster=True))
    assert clustered[: clustered.index("BroadcastExchange")].count("Exchange") == 1
