import itertools
from datetime import date, datetime

import pytest
from grid_rows import attempt, plan

from attempt_grid import AttemptCriteria, criteria_predicate, filter_attempts, normalise_selection
from attempt_grid.operators.criteria import (
    FIRST_ATTEMPT,
    REPEAT_ATTEMPTS,
    Limits,
    as_day,
    date_range,
    filter_cells,
    ordered_range,
)


@pytest.fixture
def mixed(attempts):
    rows = [
        attempt(
            user_id=f"u{n}",
            level_cohort=level,
            partition_date=date(2026, 1, day),
            payer_type=payer,
            attempt=number,
            super_ball=ball,
            traffic_type=["organic", "paid", "NULL"][n % 3],
            platform_name=["ios", "android"][n % 2],
        )
        for n, (level, day, payer, number, ball) in enumerate(
            itertools.product((1, 2, 3), (1, 2), ("payer", "payer's cohort"), (0, 1, 2, None), (True, None))
        )
    ]
    return attempts(*rows), rows


CASES = [
    (AttemptCriteria(levels=Limits(2)), lambda r: r["level_cohort"] >= 2),
    (AttemptCriteria(levels=Limits(last=2)), lambda r: r["level_cohort"] <= 2),
    (AttemptCriteria(levels=Limits(2, 2)), lambda r: r["level_cohort"] == 2),
    (AttemptCriteria(days=Limits("2026-01-02")), lambda r: r["partition_date"].day == 2),
    (AttemptCriteria(days=Limits(last=datetime(2026, 1, 1, 23))), lambda r: r["partition_date"].day == 1),
    (AttemptCriteria(values={"payer_type": ("payer's cohort",)}), lambda r: r["payer_type"] == "payer's cohort"),
    (AttemptCriteria(values={"traffic_type": ("organic", "NULL")}), lambda r: r["traffic_type"] != "paid"),
    (AttemptCriteria(values={"platform_name": ("ios",)}), lambda r: r["platform_name"] == "ios"),
    (AttemptCriteria(values={"attempt_group": (FIRST_ATTEMPT,)}), lambda r: r["attempt"] == 1),
    (AttemptCriteria(values={"attempt_group": (REPEAT_ATTEMPTS,)}), lambda r: (r["attempt"] or 0) >= 2),
    (AttemptCriteria(values={"attempt_group": (REPEAT_ATTEMPTS, FIRST_ATTEMPT)}), lambda r: True),
    (AttemptCriteria(values={"super_ball": (True,)}), lambda r: r["super_ball"] is True),
    (AttemptCriteria(values={"super_ball": (False,)}), lambda r: r["super_ball"] is False),
    (AttemptCriteria(values={"super_ball": (False, True)}), lambda r: True),
    (AttemptCriteria(), lambda r: True),
    (
        AttemptCriteria(levels=Limits(2), days=Limits(last="2026-01-01"), values={"payer_type": ("payer",), "attempt_group": (FIRST_ATTEMPT,), "super_ball": (True,)}),
        lambda r: r["level_cohort"] >= 2 and r["partition_date"].day == 1
        and r["payer_type"] == "payer" and r["attempt"] == 1 and r["super_ball"] is True,
    ),
]


@pytest.mark.parametrize(("criteria", "keeps"), CASES)
def test_filters_match_brute_force(mixed, criteria, keeps):
    frame, rows = mixed
    kept = {r["user_id"] for r in filter_attempts(frame, criteria).collect()}
    assert kept == {r["user_id"] for r in rows if keeps(r)}


def test_no_condition_is_no_filter(mixed):
    frame, _ = mixed
    assert criteria_predicate(AttemptCriteria()) is None
    assert filter_attempts(frame, AttemptCriteria()) is frame


@pytest.mark.parametrize(
    "criteria",
    [
        AttemptCriteria(levels=Limits(5, 4)),
        AttemptCriteria(values={"attempt_group": ("3 attempts",)}),
        AttemptCriteria(values={"attempt_group": (FIRST_ATTEMPT, REPEAT_ATTEMPTS, "3 attempts")}),
        AttemptCriteria(values={"super_ball": (1,)}),
        AttemptCriteria(values={"super_ball": ("true",)}),
    ],
)
def test_illegal_criteria_raise(criteria):
    with pytest.raises(ValueError):
        criteria_predicate(criteria)


def test_display_range_is_checked_too(spark):
    with pytest.raises(ValueError, match="is empty"):
        filter_cells(spark.range(1), AttemptCriteria(levels=Limits(2, 1)))


def test_normalise_selection():
    options = ("android", "ios", "uwp")
    assert normalise_selection(options, options) == ()
    assert normalise_selection((), options) == ()
    assert normalise_selection(("ios", "android"), options) == ("android", "ios")


def test_edge_helpers():
    assert as_day("2026-01-02") == as_day("2026-01-02 10:00:00") == date(2026, 1, 2)
    assert as_day(datetime(2026, 1, 2, 3)) == as_day(date(2026, 1, 2)) == date(2026, 1, 2)
    assert ordered_range(5, 2) == (2, 5)
    full = (date(2026, 1, 1), date(2026, 2, 1))
    assert date_range((date(2026, 1, 5),), full) == full
    assert date_range(full, (None, None)) == full


def test_predicates_reach_the_scan(spark, attempts, tmp_path):
    attempts(attempt()).write.partitionBy("partition_date").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    text = plan(
        filter_attempts(
            stored,
            AttemptCriteria(levels=Limits(2), days=Limits("2026-01-01"), values={"payer_type": ("a", "b"), "attempt_group": (REPEAT_ATTEMPTS,), "super_ball": (True,)}),
        )
    )
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "partition_date" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    for pushed in ("GreaterThanOrEqual(level_cohort,2)", "In(payer_type", "GreaterThanOrEqual(attempt,2)",
                   "EqualTo(super_ball,true)"):
        assert pushed in scan
