import os
from datetime import date

import pytest
from grid_rows import attempt, plan
from pyspark.sql import functions as F

from attempt_grid import (
    ATTEMPT_COLUMNS,
    AttemptCriteria,
    Limits,
    ProjectBuild,
    aggregate_statistics,
    attempts_from_payload,
    filter_cells,
    keep,
    latest_partition,
    overwrite_table,
    read_attempts_table,
    refresh,
    write_partitioned,
)
from attempt_grid.sinks.tables import shared_folder


def day_rows(*days):
    return [attempt(partition_date=date(2026, 1, d), user_id=f"u{n}") for n, d in enumerate(days)]


def files_per_day(path):
    return {
        name.split("=")[1]: sum(f.endswith(".parquet") for f in os.listdir(os.path.join(path, name)))
        for name in os.listdir(path)
        if "=" in name
    }


def test_roundtrip_is_lossless(spark, attempts, tmp_path):
    frame = attempts(*day_rows(1, 1, 2, 3))
    write_partitioned(frame, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).select(*ATTEMPT_COLUMNS)
    assert stored.schema["partition_date"].dataType.typeName() == "date"
    assert sorted(stored.collect()) == sorted(frame.collect())
    assert files_per_day(tmp_path / "t") == {f"2026-01-0{d}": 1 for d in (1, 2, 3)}


def test_overwrite_replaces_all_days_or_only_the_present_ones(spark, attempts, tmp_path):
    path = str(tmp_path / "t")
    write_partitioned(attempts(*day_rows(1, 2, 2)), path)
    write_partitioned(attempts(*day_rows(2)), path, only_present_days=True)
    counts = {r[0].day: r[1] for r in spark.read.parquet(path).groupBy("partition_date").count().collect()}
    assert counts == {1: 1, 2: 1}
    write_partitioned(attempts(*day_rows(3)), path)
    assert [r[0].day for r in spark.read.parquet(path).select("partition_date").collect()] == [3]


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    # One day holds over a third of all rows.
    rows = spark.range(200_000, numPartitions=8).select(
        F.sha2(F.col("id").cast("string"), 512).alias("user_id"),
        (F.col("id") % 50).cast("int").alias("level_cohort"),
        F.when(F.col("id") % 5 < 2, F.lit(1)).otherwise(2 + F.col("id") % 20).cast("int").alias("d"),
    ).select("user_id", "level_cohort", F.date_add(F.lit(date(2026, 1, 1)), F.col("d") - 1).alias("partition_date"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        write_partitioned(rows, str(tmp_path / "t"))
    finally:
        spark.conf.set(key, before)
    files = files_per_day(tmp_path / "t")
    assert files["2026-01-01"] > 3
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(rows.select("user_id", "level_cohort", "partition_date")).isEmpty()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_table_overwrite_and_schema_replacement(spark, attempts):
    overwrite_table(attempts(*day_rows(1, 2)), "sink_table")
    assert read_attempts_table(spark, "sink_table").count() == 2
    wider = attempts(*day_rows(5)).withColumn("extra", F.lit("x"))
    overwrite_table(wider, "sink_table")
    assert "extra" in spark.table("sink_table").columns
    assert latest_partition(spark.table("sink_table")).first()[0] == date(2026, 1, 5)
    overwrite_table(attempts(*day_rows(7)), "sink_table", replace_schema=True)
    assert "extra" not in spark.table("sink_table").columns
    assert spark.table("sink_table").count() == 1


def test_latest_partition_reads_no_data_columns(spark, attempts):
    overwrite_table(attempts(*day_rows(1, 2)), "dated_table")
    assert "ReadSchema: struct<>" in plan(latest_partition(spark.table("dated_table")))


def test_display_range_prunes_partitions_of_a_lazy_aggregate(spark, attempts):
    overwrite_table(attempts(*day_rows(1, 2, 3)), "pruned_table")
    statistics = aggregate_statistics(read_attempts_table(spark, "pruned_table"), AttemptCriteria())
    text = plan(filter_cells(statistics, AttemptCriteria(levels=Limits(3), days=Limits("2026-01-02"))))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "partition_date" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(level_cohort,3)" in scan


def test_kept_statistics_are_not_recomputed(spark, attempts, tmp_path):
    statistics = aggregate_statistics(attempts(*day_rows(1, 2, 2)))
    kept = keep(statistics, str(tmp_path / "kept"))
    assert kept.dtypes == statistics.dtypes
    assert sorted(kept.collect()) == sorted(statistics.collect())
    assert "Aggregate" not in plan(filter_cells(kept, AttemptCriteria(levels=Limits(1))))


def test_shared_folder_is_where_the_session_says(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark), shared_folder(spark)
    assert first.startswith(root + "/") and first != second
    assert keep(spark.range(3)).count() == 3


def test_refresh_of_one_day_leaves_the_others(spark, attempts):
    def files(table):
        folder = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first()[1].removeprefix("file:")
        return {d: sorted(os.listdir(os.path.join(folder, d))) for d in os.listdir(folder) if "=" in d}

    build = lambda *days: lambda: attempts(*day_rows(*days))
    refresh(spark, [ProjectBuild("p", "daily_attempts", build(1, 2, 2, 3), True, segment_table="daily_segments")])
    before = {t: files(t) for t in ("daily_attempts", "daily_segments")}
    status = refresh(
        spark,
        [ProjectBuild("p", "daily_attempts", build(2, 4), True, only_present_days=True, segment_table="daily_segments")],
    )
    assert status.first()["latest_partition"] == "2026-01-04"
    for table, old in before.items():
        new = files(table)
        assert set(new) == {f"partition_date=2026-01-0{d}" for d in (1, 2, 3, 4)}
        assert {d for d in old if new[d] != old[d]} == {"partition_date=2026-01-02"}
    assert read_attempts_table(spark, "daily_attempts").count() == 4
    assert spark.table("daily_segments").agg(F.sum("attempts_total")).first()[0] == 4


def test_refresh_reads_its_input_once_and_keeps_attempts_without_a_day(spark, attempts):
    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return lambda: attempts(*rows).mapInArrow(run, attempts(*rows).schema)

    def daily(rows):
        options = {"only_present_days": True, "segment_table": "once_segments"}
        refresh(spark, [ProjectBuild("p", "once_attempts", counted(rows), True, **options)])
        return {str(r[0]): r[1] for r in spark.table("once_segments").groupBy("partition_date").agg(F.sum("attempts_total")).collect()}

    dayless = dict(day_rows(1)[0], partition_date=None)
    assert daily([*day_rows(1, 1, 2), dayless]) == {"2026-01-01": 2, "2026-01-02": 1, "None": 1}
    assert read.value == 4
    assert daily([*day_rows(2, 2), dayless, dayless]) == {"2026-01-01": 2, "2026-01-02": 2, "None": 2}
    assert daily(day_rows(3)) == {"2026-01-01": 2, "2026-01-02": 2, "2026-01-03": 1, "None": 2}
    assert read.value == 9


def test_build_of_one_day_reads_one_day(spark, tmp_path):
    from grid_checks import sample_tables as sample

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(sf):
        pytest.skip("no sample tables")
    write_partitioned(sample.levels_from_events(spark, sf, chained=False), str(tmp_path / "levels"))
    levels = spark.read.parquet(str(tmp_path / "levels"))
    players = sample.players_from_customer(spark, sf)
    rules = {"bucket_width": 100, "cutoff": "2024-01-05"}
    one = attempts_from_payload(levels, players, days=Limits("2024-01-10", "2024-01-10"), **rules)
    assert "PartitionFilters: [isnotnull(partition_date" in plan(one) and "= 2024-01-10" in plan(one)
    whole = attempts_from_payload(levels, players, **rules).filter("partition_date = '2024-01-10'")
    assert sorted(map(str, one.collect())) == sorted(map(str, whole.collect())) != []
    assert "SortMergeJoin" not in plan(one) and plan(one).count("Exchange hashpartitioning(user_id") == 0
