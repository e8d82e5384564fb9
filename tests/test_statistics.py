import random
from datetime import date

import pytest
from grid_rows import attempt, plan
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from attempt_grid import (
    STATISTIC_COLUMNS,
    AttemptCriteria,
    GridRequest,
    Limits,
    aggregate_statistics,
    filter_cells,
    filter_options,
    grid_cells,
    grid_cells_from_segments,
    read_filter_options,
    read_segment_options,
    segment_options,
    segment_totals,
    statistics_from_segments,
)
from attempt_grid.operators.criteria import FIRST_ATTEMPT, REPEAT_ATTEMPTS
from attempt_grid.operators.health import missing_values

OUTCOME_OF = {"far_win": "FW", "close_win": "CW", "close_fail": "CF", "far_fail": "FF"}


def random_attempts(count, seed=7):
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        segment = draw.choice([*OUTCOME_OF, "unknown"])
        number = draw.randint(1, 4)
        flags = {flag: int(name == segment) for name, flag in OUTCOME_OF.items()}
        rows.append(
            attempt(
                user_id=f"u{n}",
                # Cell (10, day 1) holds about a third of all rows.
                level_cohort=10 if n % 3 == 0 else draw.randint(8, 12),
                partition_date=date(2026, 1, 1 if n % 3 == 0 else draw.randint(1, 5)),
                payer_type=draw.choice(["payer", "nonpayer"]),
                failed=draw.randint(0, 1),
                attempt=number,
                first_attempt=int(number == 1),
                reason_seg=segment,
                **flags,
            )
        )
    return rows


def percent(part, whole):
    return part / whole * 100 if whole else 0.0


def brute_force(rows):
    cells = {}
    for row in rows:
        cells.setdefault((row["level_cohort"], row["partition_date"]), []).append(row)
    result = {}
    for key, members in cells.items():
        total = float(len(members))
        s = {f"{f}_absolute": float(sum(r[f] for r in members)) for f in ("FW", "CW", "CF", "FF")}
        s["wins_absolute"] = s["FW_absolute"] + s["CW_absolute"]
        s["fails_absolute"] = s["FF_absolute"] + s["CF_absolute"]
        s["attempts_absolute"] = total
        s["failed_absolute"] = float(sum(r["failed"] for r in members))
        s["attempt_average"] = sum(r["attempt"] for r in members) / total
        s["first_attempt_absolute"] = float(sum(r["first_attempt"] for r in members))
        for f in ("FW", "CW", "CF", "FF"):
            s[f"{f}_relative"] = percent(s[f"{f}_absolute"], total)
            side = "wins_absolute" if f in ("FW", "CW") else "fails_absolute"
            s[f"{f}_partial_relative"] = percent(s[f"{f}_absolute"], s[side])
        s["fail_rate_relative"] = percent(s["failed_absolute"], total)
        s["win_rate_relative"] = 100 - s["fail_rate_relative"]
        s["first_attempt_relative"] = percent(s["first_attempt_absolute"], total)
        result[key] = s
    return result


def test_three_attempts_by_hand(attempts):
    frame = attempts(
        attempt(user_id="u1", failed=1, attempt=1, first_attempt=1, CF=1, reason_seg="close_fail"),
        attempt(user_id="u2", failed=0, attempt=2, first_attempt=0, FW=1, reason_seg="far_win"),
        attempt(user_id="u3", failed=1, attempt=3, first_attempt=0, CF=1, reason_seg="close_fail"),
    )
    (row,) = aggregate_statistics(frame, AttemptCriteria()).collect()
    assert (row["level_group"], row["date"]) == (10, date(2026, 1, 1))
    expected = {
        "attempts_absolute": 3, "wins_absolute": 1, "fails_absolute": 2, "CF_absolute": 2,
        "CF_relative": 2 / 3 * 100, "CF_partial_relative": 100, "failed_absolute": 2,
        "fail_rate_relative": 2 / 3 * 100, "win_rate_relative": 1 / 3 * 100, "attempt_average": 2,
        "first_attempt_absolute": 1, "first_attempt_relative": 1 / 3 * 100,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


def test_unknown_outcomes_count_in_neither_side(attempts):
    (row,) = aggregate_statistics(attempts(attempt(), attempt(FW=1), attempt(failed=1))).collect()
    assert (row["wins_absolute"], row["fails_absolute"], row["attempts_absolute"]) == (1, 0, 3)
    # No fails at all: the share inside fails is 0, and the win rate is not wins / attempts.
    assert row["FF_partial_relative"] == row["CF_partial_relative"] == 0.0
    assert row["win_rate_relative"] == pytest.approx(200 / 3)


def test_null_flags_stay_null(attempts):
    (row,) = aggregate_statistics(attempts(attempt(FW=None))).collect()
    assert row["FW_absolute"] is None and row["wins_absolute"] is None
    assert row["FW_relative"] is None and row["FW_partial_relative"] == 0.0


def test_schema_and_order(attempts):
    result = aggregate_statistics(attempts(*random_attempts(100)))
    assert result.columns == ["level_group", "date", *STATISTIC_COLUMNS]
    kinds = [f.dataType.typeName() for f in result.schema]
    assert kinds == ["integer", "date"] + ["double"] * 21
    keys = [(r["level_group"], r["date"]) for r in result.collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(attempts, seed):
    rows = random_attempts(600, seed)
    expected = brute_force(rows)
    found = aggregate_statistics(attempts(*rows), ordered=False).collect()
    assert len(found) == len(expected)
    for row in found:
        for name, value in expected[row["level_group"], row["date"]].items():
            assert row[name] == pytest.approx(value), name


def test_display_range_equals_the_same_range_before_grouping(attempts):
    frame = attempts(*random_attempts(500)).cache()
    shared = {"values": {"payer_type": ("payer",), "attempt_group": (FIRST_ATTEMPT,)}}
    limits = {"levels": Limits(9, 11), "days": Limits("2026-01-02", "2026-01-04")}
    after = filter_cells(aggregate_statistics(frame, AttemptCriteria(**shared)), AttemptCriteria(**limits))
    before = aggregate_statistics(frame, AttemptCriteria(**shared, **limits))
    with pytest.raises(ValueError):
        filter_cells(before, AttemptCriteria(**shared))
    assert after.collect() == before.collect() != []


def test_one_shuffle_and_map_side_aggregation(attempts):
    text = plan(aggregate_statistics(attempts(attempt()), ordered=False))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text and "partial_avg" in text


def test_empty_input(attempts):
    assert aggregate_statistics(attempts(attempt()).filter(F.lit(False))).collect() == []


@pytest.mark.parametrize(
    "criteria",
    [
        None,
        AttemptCriteria(values={"attempt_group": (FIRST_ATTEMPT,), "payer_type": ("payer",)}),
        AttemptCriteria(levels=Limits(9), days=Limits(last="2026-01-04"), values={"attempt_group": (REPEAT_ATTEMPTS,)}),
        AttemptCriteria(values={"super_ball": (True,)}),
    ],
)
def test_segments_give_the_same_statistics(attempts, criteria):
    odd = [attempt(attempt=None, FW=None), attempt(attempt=0), attempt(attempt=-3, super_ball=None)]
    lonely = attempt(level_cohort=77, attempt=None, failed=None)
    frame = attempts(*random_attempts(400), *odd, lonely).cache()
    segments = segment_totals(frame)
    assert segments.count() < frame.count()
    direct = aggregate_statistics(frame, criteria).collect()
    assert statistics_from_segments(segments, criteria).collect() == direct
    assert segment_options(segments).collect() == filter_options(frame).collect()
    assert read_segment_options(segments) == read_filter_options(frame)
    request = GridRequest("fail_rate", "relative", 3, criteria or AttemptCriteria())
    cells = lambda f: sorted(map(str, f.collect()))
    assert cells(grid_cells_from_segments(segments, request)) == cells(grid_cells(frame, request))


def test_segments_are_not_taken_for_attempts(attempts):
    segments = segment_totals(attempts(attempt()))
    for reader in (aggregate_statistics, filter_options, missing_values):
        with pytest.raises(AnalysisException):
            reader(segments)
