"""From raw events to a displayed grid, the way the README does it."""

from datetime import date
from pathlib import Path

import pytest

import attempt_grid as ag
from grid_checks import sample_tables as sample

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def attempts(spark):
    built = ag.attempts_from_payload(
        sample.levels_from_events(spark, SF, chained=False),
        sample.players_from_customer(spark, SF),
        bucket_width=100,
        cutoff="2024-01-01",
        broadcast_bytes=10 << 20,
    )
    ag.rebuild_table(built, "end_to_end_attempts")
    return ag.read_attempts_table(spark, "end_to_end_attempts")


def test_build_to_grid(attempts):
    options = ag.read_filter_options(attempts)
    assert options.days.first > date(2024, 1, 1) and options.values["payer_type"] == ("nonpayer", "payer")
    criteria = ag.AttemptCriteria(values={"payer_type": ("payer",), "attempt_group": ("1 attempt",)})
    statistics = ag.keep(ag.aggregate_statistics(attempts, criteria))
    request = ag.GridRequest("fail_rate", "relative", min_observations=2)
    values = ag.metric_cells(statistics, request)
    cells = ag.mask_low_samples(ag.dense_grid(values))
    wide = ag.pivot_grid(cells, value="visible_value")

    levels = {r["level_group"] for r in values.collect()}
    days = {r["date"] for r in values.collect()}
    assert cells.count() == len(levels) * len(days)
    assert wide.columns == ["level_group", *[d.isoformat() for d in sorted(days)]]
    shown = {(r["level_group"], r["date"]): r["value"] for r in ag.grid_records(wide).collect()}
    expected = {
        (r["level_group"], r["date"]): r["value"] for r in values.collect() if not r["is_low_sample"]
    }
    assert shown == expected


def test_one_lazy_plan_gives_the_same_cells(attempts):
    criteria = ag.AttemptCriteria(levels=ag.Limits(2), values={"platform_name": ("ios",)})
    shown = ag.AttemptCriteria(levels=ag.Limits(last=6), days=ag.Limits("2024-01-10"))
    request = ag.GridRequest("win_rate", "relative", 3, criteria, shown)
    stepwise = ag.mask_low_samples(
        ag.metric_cells(ag.keep(ag.aggregate_statistics(attempts, criteria)), request)
    )
    assert sorted(ag.grid_cells(attempts, request).collect()) == sorted(stepwise.collect()) != []


def test_segments_grow_day_by_day(spark, attempts, tmp_path):
    path = str(tmp_path / "segments")
    days = [r[0] for r in attempts.select("partition_date").distinct().collect()]
    for day in sorted(days)[:3]:
        part = attempts.filter(attempts["partition_date"] == day)
        ag.write_partitioned(ag.segment_totals(part), path, only_present_days=True)
    first_three = ag.AttemptCriteria(days=ag.Limits(last=sorted(days)[2]))
    grown = ag.statistics_from_segments(spark.read.parquet(path))
    assert grown.collect() == ag.aggregate_statistics(attempts, first_three).collect()
