from datetime import date

from grid_rows import attempt, plan
from pyspark.sql import functions as F

from attempt_grid import distinct_values, filter_options, read_filter_options
from attempt_grid.operators.options import attempt_group_presence, bounds, super_ball_presence


def test_record(attempts):
    found = read_filter_options(
        attempts(
            attempt(level_cohort=0, payer_type="payer", traffic_type="paid", super_ball=False),
            attempt(level_cohort=900, payer_type="nonpayer", traffic_type="NULL", attempt=2,
                    partition_date=date(2026, 2, 19)),
            attempt(platform_name="android", super_ball=True, attempt=0),
        )
    )
    assert (found.levels.first, found.levels.last) == (0, 900)
    assert (found.days.first, found.days.last) == (date(2026, 1, 1), date(2026, 2, 19))
    assert found.values["payer_type"] == ("nonpayer", "payer")
    assert found.values["traffic_type"] == ("NULL", "organic", "paid")
    assert found.values["platform_name"] == ("android", "ios")
    assert found.values["attempt_group"] == ("1 attempt", "2+ attempts")
    assert found.values["super_ball"] == (True, False)


def test_one_sided_values(attempts):
    found = read_filter_options(attempts(attempt(attempt=5), attempt(attempt=None, super_ball=None)))
    assert found.values["attempt_group"] == ("2+ attempts",)
    assert found.values["super_ball"] == (False,)


def test_empty_input(attempts):
    found = read_filter_options(attempts(attempt()).filter(F.lit(False)))
    assert found.levels.first is None and found.days.last is None
    assert found.values["payer_type"] == found.values["attempt_group"] == found.values["super_ball"] == ()


def test_single_operators_agree_with_the_record(attempts):
    frame = attempts(attempt(super_ball=True), attempt(attempt=3, level_cohort=2))
    record = read_filter_options(frame)
    assert bounds(frame).first()["level_min"] == record.levels.first == 2
    assert tuple(attempt_group_presence(frame).first()[0]) == record.values["attempt_group"]
    assert tuple(super_ball_presence(frame).first()[0]) == record.values["super_ball"]
    values = [r[0] for r in distinct_values(frame, "platform_name").collect()]
    assert tuple(values) == record.values["platform_name"]


def test_distinct_values_drop_null_and_keep_empty(attempts):
    frame = attempts(attempt(payer_type=None), attempt(payer_type=""), attempt(payer_type="a"))
    assert [r[0] for r in distinct_values(frame, "payer_type").collect()] == ["", "a"]


def test_one_scan(attempts, spark, tmp_path):
    attempts(attempt()).write.parquet(str(tmp_path / "t"))
    text = plan(filter_options(spark.read.parquet(str(tmp_path / "t"))))
    assert text.count("FileScan") == 1
    # Lists are collected from distinct combinations, never from raw rows.
    assert text.index("collect_set") < text.index("partial_min(level_cohort")
