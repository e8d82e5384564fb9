import pytest
from grid_rows import attempt

from attempt_grid import (
    METRICS,
    STATISTIC_COLUMNS,
    aggregate_statistics,
    metric_methods,
    metric_names,
    select_metric,
    select_metric_values,
)
from attempt_grid.operators.metrics import find_metric


@pytest.fixture
def statistics(attempts):
    return aggregate_statistics(
        attempts(
            attempt(failed=1, CF=1),
            attempt(failed=1, FF=1, attempt=3),
            attempt(FW=1),
            attempt(),
            attempt(level_cohort=11, CF=1),
        )
    )


def test_registry():
    assert len(METRICS) == 17
    assert metric_names() == ["CF", "CW", "FF", "FW", "attempt", "failed", "wins", "fail_rate", "win_rate"]
    assert metric_methods("CF") == ["absolute", "relative", "partial_relative"]
    assert metric_methods("attempt") == ["average"]
    assert metric_methods("attempts") == []
    for metric in METRICS:
        assert {metric.value, metric.sample, metric.numerator or metric.value} <= set(STATISTIC_COLUMNS)


def test_counts_that_are_not_selectable():
    assert not {"attempts", "first_attempt", "fails"} & set(metric_names())
    with pytest.raises(ValueError, match="has no"):
        find_metric("attempts", "absolute")
    with pytest.raises(ValueError, match="has no"):
        find_metric("CF", "average")


def test_values_without_context(statistics):
    result = select_metric_values(statistics, "wins", "absolute")
    assert result.columns == ["level_group", "date", "value", "metric_name", "calculation_method"]
    assert [r["value"] for r in result.collect()] == [1.0, 0.0]


def test_context_of_a_share(statistics):
    rows = select_metric(statistics, "CF", "partial_relative", min_observations=2).collect()
    assert [(r["value"], r["value_count"], r["sample_count"], r["is_low_sample"]) for r in rows] == [
        (50.0, 1.0, 2.0, False),
        (100.0, 1.0, 1.0, True),
    ]


def test_low_sample_is_strict_and_off_by_default(statistics):
    def flags(minimum):
        rows = select_metric(statistics, "fail_rate", "relative", min_observations=minimum).collect()
        return [r["is_low_sample"] for r in rows]

    assert flags(4) == [False, True]
    assert flags(5) == [True, True]
    assert [r["is_low_sample"] for r in select_metric(statistics, "fail_rate", "relative").collect()] == [
        False,
        False,
    ]


def test_counts_and_averages_are_never_low_sample(statistics):
    for name, method in (("attempt", "average"), ("failed", "absolute"), ("CF", "absolute")):
        rows = select_metric(statistics, name, method, min_observations=10**6).collect()
        assert not any(r["is_low_sample"] for r in rows)


def test_metric_without_numerator_counts_its_value(statistics):
    row = select_metric(statistics, "attempt", "average").first()
    assert row["value"] == row["value_count"] == 1.5
    assert row["sample_count"] == 4.0


def test_win_rate_context_is_the_known_wins(statistics):
    row = select_metric(statistics, "win_rate", "relative").first()
    assert (row["value"], row["value_count"], row["sample_count"]) == (50.0, 1.0, 4.0)
