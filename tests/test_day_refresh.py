from datetime import date

import pytest
from grid_rows import attempt
from pyspark.sql import functions as F

from attempt_grid import Limits, ProjectBuild, finish_refreshes, overwrite_table, read_attempts_table, refresh, refresh_days, refresh_log
from attempt_grid.sinks import day_refresh

JANUARY = Limits("2026-01-01", "2026-01-31")


def day(d, month=1):
    return date(2026, month, d)


def rows_on(*days, **changes):
    return [attempt(partition_date=d, user_id=f"u{n}", **changes) for n, d in enumerate(days)]


def per_day(spark, name):
    return {r[0]: r[1] for r in spark.table(name).groupBy("partition_date").count().collect()}


def staged_tables(spark, name):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name}__staged_")]


def test_requested_days_replace_present_ones(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1), day(2), day(2), day(3), None, day(1, 2))), "range_table")
    refresh_days(attempts(*rows_on(day(2), day(4))), "range_table", JANUARY)
    # days 1 and 3 were asked for and are empty now; February and the rows without a day stay
    assert per_day(spark, "range_table") == {day(2): 1, day(4): 1, None: 1, day(1, 2): 1}
    refresh_days(attempts(), "range_table", [day(4), None])
    assert per_day(spark, "range_table") == {day(2): 1, day(1, 2): 1}
    assert staged_tables(spark, "range_table") == []
    assert {r["state"] for r in refresh_log(spark, "range_table").collect()} == {"staged", "done"}


def test_without_requested_days_the_present_ones_are_replaced(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1), day(2), day(2), None)), "present_table")
    assert set(refresh_days(attempts(*rows_on(day(2), None, None)), "present_table")) == {day(2), None}
    assert per_day(spark, "present_table") == {day(1): 1, day(2): 1, None: 2}


def test_a_missing_table_is_created(spark, attempts):
    refresh_days(attempts(*rows_on(day(1))), "created_table", JANUARY)
    assert per_day(spark, "created_table") == {day(1): 1}
    refresh_days(attempts(), "created_empty_table", JANUARY)
    assert per_day(spark, "created_empty_table") == {}


def test_a_stray_day_fails_before_the_table_changes(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1))), "stray_table")
    for stray in (day(1, 2), None):
        with pytest.raises(Exception, match="not requested"):
            refresh_days(attempts(*rows_on(day(1), day(2), stray)), "stray_table", JANUARY, run_id="stray")
    assert per_day(spark, "stray_table") == {day(1): 1}
    # the same run may be repeated with the right rows
    refresh_days(attempts(*rows_on(day(2))), "stray_table", JANUARY, run_id="stray")
    assert per_day(spark, "stray_table") == {day(2): 1}
    assert staged_tables(spark, "stray_table") == []


class Killed(Exception):
    pass


@pytest.mark.parametrize("swapped", [False, True])
def test_a_run_killed_around_the_swap_is_finished_later(spark, attempts, monkeypatch, swapped):
    name, swap = f"killed_table_{swapped}".lower(), day_refresh._swap
    overwrite_table(attempts(*rows_on(day(1), day(2), day(3))), name)

    def killed(*args):
        if swapped:
            swap(*args)
        raise Killed

    monkeypatch.setattr(day_refresh, "_swap", killed)
    with pytest.raises(Killed):
        refresh_days(attempts(*rows_on(day(2), day(2))), name, JANUARY, run_id="r1")
    before, after = {day(1): 1, day(2): 1, day(3): 1}, {day(2): 2}
    assert per_day(spark, name) == (after if swapped else before)
    monkeypatch.setattr(day_refresh, "_swap", swap)
    assert finish_refreshes(spark, name) == ["r1"]
    assert per_day(spark, name) == after
    assert finish_refreshes(spark, name) == [] and staged_tables(spark, name) == []
    # the run is done, so the scheduler's second try does nothing
    refresh_days(attempts(*rows_on(day(5))), name, JANUARY, run_id="r1")
    assert per_day(spark, name) == after


def test_a_run_killed_while_staging_never_happened(spark, attempts, monkeypatch):
    overwrite_table(attempts(*rows_on(day(1))), "unlogged_table")

    def killed(*args):
        raise Killed

    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(day_refresh, "_write_log", killed)
        refresh_days(attempts(*rows_on(day(1), day(1))), "unlogged_table", JANUARY, run_id="r1")
    assert finish_refreshes(spark, "unlogged_table") == [] and per_day(spark, "unlogged_table") == {day(1): 1}
    refresh_days(attempts(*rows_on(day(1), day(1))), "unlogged_table", JANUARY, run_id="r1")
    assert per_day(spark, "unlogged_table") == {day(1): 2} and staged_tables(spark, "unlogged_table") == []


def test_the_next_refresh_finishes_the_last_one(spark, attempts, monkeypatch):
    def killed(*args):
        raise Killed

    overwrite_table(attempts(*rows_on(day(1), day(2))), "chained_table")
    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(day_refresh, "_swap", killed)
        refresh_days(attempts(*rows_on(day(1), day(1))), "chained_table", [day(1)])
    refresh_days(attempts(*rows_on(day(2), day(2), day(2))), "chained_table", [day(2)])
    assert per_day(spark, "chained_table") == {day(1): 2, day(2): 3}


def test_an_added_column_is_null_on_other_days(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1), day(2))), "wider_table")
    # another order of columns as well
    frame = attempts(*rows_on(day(2))).withColumn("extra", F.lit("x"))
    refresh_days(frame.select(*reversed(frame.columns)), "wider_table", [day(2)])
    found = spark.table("wider_table").orderBy("partition_date").select("user_id", "extra", "level_cohort", "partition_date")
    assert [tuple(r) for r in found.collect()] == [("u0", None, 10, day(1)), ("u0", "x", 10, day(2))]
    assert read_attempts_table(spark, "wider_table").count() == 2


def test_a_missing_column_is_null(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1), day(2))).withColumn("extra", F.lit("x")), "narrower_table")
    refresh_days(attempts(*rows_on(day(2))), "narrower_table", [day(2)])
    found = spark.table("narrower_table").orderBy("partition_date").select("extra")
    assert [r[0] for r in found.collect()] == ["x", None]


def test_a_retyped_column_is_cast_or_fails(spark, attempts):
    overwrite_table(attempts(*rows_on(day(1), day(2), balance_id=7)), "retyped_table")
    text = lambda value: attempts(*rows_on(day(2))).withColumn("balance_id", F.lit(value))
    refresh_days(text("1234"), "retyped_table", [day(2)])
    assert dict(spark.table("retyped_table").dtypes)["balance_id"] == "int"
    assert [r[0] for r in spark.table("retyped_table").orderBy("partition_date").select("balance_id").collect()] == [7, 1234]
    for unfit in ("twelve", 1 << 40):
        with pytest.raises(Exception, match="CAST"):
            refresh_days(text(unfit), "retyped_table", [day(2)])
    assert [r[0] for r in spark.table("retyped_table").orderBy("partition_date").select("balance_id").collect()] == [7, 1234]


def test_replace_schema_rewrites_the_other_days(spark, attempts, monkeypatch):
    overwrite_table(attempts(*rows_on(day(1), day(2), balance_id=7)).withColumn("old", F.lit(1)), "replaced_table")
    frame = attempts(*rows_on(day(2))).withColumn("balance_id", F.lit(1 << 40)).withColumn("new", F.lit("n"))
    swap = day_refresh._swap

    def killed_in_the_middle(spark, name, entry):
        spark.sql(f"DROP TABLE {name}")
        raise Killed

    with monkeypatch.context() as patch, pytest.raises(Killed):
        patch.setattr(day_refresh, "_swap", killed_in_the_middle)
        refresh_days(frame, "replaced_table", [day(2)], replace_schema=True)
    assert day_refresh._swap is swap and len(finish_refreshes(spark, "replaced_table")) == 1
    table = spark.table("replaced_table")
    assert set(table.columns) == set(frame.columns) and dict(table.dtypes)["balance_id"] == "bigint"
    found = table.orderBy("partition_date").select("balance_id", "new")
    assert [tuple(r) for r in found.collect()] == [(7, None), (1 << 40, "n")]


def test_the_session_keeps_its_settings(spark, attempts):
    before = spark.conf.get(day_refresh.OVERWRITE_MODE)
    overwrite_table(attempts(*rows_on(day(1), day(2))), "settings_table")
    refresh_days(attempts(*rows_on(day(1))), "settings_table", [day(1)])
    assert spark.conf.get(day_refresh.OVERWRITE_MODE) == before


def test_refresh_empties_days_of_attempts_and_segments(spark, attempts):
    def run(frame, **options):
        build = ProjectBuild("p", "emptied_attempts", lambda: frame, True, segment_table="emptied_segments", **options)
        return refresh(spark, [build]).first()["latest_partition"]

    assert run(attempts(*rows_on(day(1), day(2), day(2), day(3)))) == "2026-01-03"
    assert run(attempts(*rows_on(day(2))), days=Limits(day(2), day(3))) == "2026-01-02"
    assert per_day(spark, "emptied_attempts") == {day(1): 1, day(2): 1}
    totals = spark.table("emptied_segments").groupBy("partition_date").agg(F.sum("attempts_total"))
    assert {r[0]: r[1] for r in totals.collect()} == {day(1): 1, day(2): 1}
