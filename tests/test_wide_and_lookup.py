"""Grids of thousands of days, columns of millions of values, lookups of single players."""

from datetime import date, timedelta

import pytest
from grid_rows import plan
from pyspark.sql import functions as F

from attempt_grid import grid_records, pivot_grid, write_partitioned
from attempt_grid.operators.grid import block_columns, block_records, grid_blocks
from attempt_grid.operators.mart import player_trajectory
from attempt_grid.operators.options import distinct_values, offered_values
from attempt_grid.sinks.tables import write_lookup


def cells(spark, levels, days, every=1):
    ids = spark.range(0, levels * days, every, numPartitions=4)
    return ids.select(
        (F.col("id") % levels).cast("int").alias("level_group"),
        F.date_add(F.lit(date(2000, 1, 1)), (F.col("id") / levels).cast("int")).alias("date"),
        (F.col("id") * 0.5).alias("value"),
    )


def rows_of(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()))


@pytest.mark.parametrize("block_days", [1, 7, 366])
def test_blocks_are_the_grid(spark, block_days):
    values = cells(spark, 5, 40, 3).unionAll(spark.createDataFrame([(9, date(1969, 12, 30), 1.0), (None, date(1960, 2, 29), 2.0)], "l int, d date, v double"))
    values = values.withColumn("value", F.when(F.col("value") != 7.5, F.col("value")))
    blocks = grid_blocks(values, block_days=block_days)
    assert {len(r["values"]) for r in blocks.collect()} == {block_days}
    assert rows_of(block_records(blocks)) == rows_of(grid_records(pivot_grid(values)))
    first, last = date(2000, 1, 5), date(2000, 1, 19)
    shown = block_columns(blocks, first, last, block_days=block_days)
    inside = values.filter(F.col("date").between(first, last))
    wide = pivot_grid(inside, [first + timedelta(days=n) for n in range(15)])
    assert shown.columns == wide.columns
    assert {r["level_group"]: tuple(r) for r in shown.collect() if any(tuple(r)[1:])} == {
        r["level_group"]: tuple(r) for r in wide.collect() if any(tuple(r)[1:])
    }


def test_thousands_of_days_have_the_plan_of_a_few(spark):
    long, short = cells(spark, 20, 5000), cells(spark, 20, 5)
    assert len(plan(grid_blocks(long))) < len(plan(grid_blocks(short))) + 200
    found = block_records(grid_blocks(long))
    assert found.count() == 100_000
    assert found.exceptAll(long.select("level_group", "date", "value")).isEmpty()


def test_blocks_reject_bad_cells(spark):
    twice = spark.createDataFrame([(1, date(2026, 1, 1), 1.0), (1, date(2026, 1, 1), None)], "level_group int, date date, value double")
    with pytest.raises(Exception, match="(?i)cell"):
        grid_blocks(twice).collect()
    lost = spark.createDataFrame([(1, None, 1.0)], "level_group int, date date, value double")
    with pytest.raises(Exception, match="(?i)day"):
        grid_blocks(lost).collect()
    assert grid_blocks(twice.limit(0)).count() == 0
    with pytest.raises(ValueError):
        grid_blocks(twice, block_days=0)


def test_offered_values_of_few_are_exact(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).alias("a"),
        (F.col("id") % 3).alias("b"), F.lit(None).cast("string").alias("none"),
    )
    found = {r["column"]: (r["values"], r["counts"], r["is_complete"]) for r in offered_values(rows, ["a", "b", "none"]).collect()}
    assert found == {
        "a": (["v1", "v3", "v0", "v2"], [250, 250, 200, 200], True),
        "b": (["0", "1", "2"], [334, 333, 333], True),
        "none": ([], [], True),
    }
    assert [r["a"] for r in distinct_values(rows, "a").collect()] == ["v0", "v1", "v2", "v3"]
    (short,) = offered_values(rows, ["a"], most=2).collect()
    assert tuple(short) == ("a", ["v1", "v3"], [250, 250], False)
    (empty,) = offered_values(rows.limit(0), ["a"]).collect()
    assert tuple(empty) == ("a", [], [], True)
    with pytest.raises(ValueError):
        offered_values(rows, ["a"], most=10, tracked=10)


def test_offered_values_of_millions_stay_bounded(spark):
    n = 3_000_000
    value = F.when(F.col("id") % 10 == 0, F.concat(F.lit("hot"), (F.col("id") % 50).cast("string"))).otherwise(F.col("id").cast("string"))
    (row,) = offered_values(spark.range(n, numPartitions=4).select(value.alias("v")), ["v"], most=20).collect()
    assert 5 <= len(row["values"]) <= 20 and not row["is_complete"]
    assert {f"hot{k}" for k in range(0, 50, 10)} <= set(row["values"][:5])
    for count in row["counts"][:5]:
        assert n / 50 <= count <= n / 50 + n / 1000


def scanned(frame):
    """Rows that the file scan of a query without a shuffle returned."""
    found = frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return len(found), leaf.metrics().apply("numOutputRows").value()


def test_a_player_is_looked_up_in_few_row_groups(spark, tmp_path):
    # 20 days with 5,000 players each, of whom every day has others; one player comes on three days
    day = (F.col("id") / 5000).cast("int")
    rows = spark.range(100_000, numPartitions=4).select(
        F.when(F.col("id").isin(7, 35_007, 90_001), F.lit("p-me")).otherwise(F.concat(F.lit("p-"), F.md5(F.col("id").cast("string")))).alias("user_id"),
        F.timestamp_seconds(F.col("id")).alias("client_time"), (F.col("id") % 90).cast("int").alias("level_cohort"),
        F.lit("far_win").alias("reason_seg"), F.date_add(F.lit(date(2026, 1, 1)), day).alias("partition_date"),
    )
    fast, plain = str(tmp_path / "lookup"), str(tmp_path / "plain")
    write_lookup(rows, fast)
    write_partitioned(rows, plain)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ask = lambda path: spark.read.parquet(path).filter(F.col("user_id").isin("p-5")).select("level_cohort")
        me = lambda path: spark.read.parquet(path).filter(F.col("user_id") == "p-me").select("level_cohort")
        assert scanned(ask(fast)) == (0, 0)  # between the first and last player of every file, and in none
        found, read = scanned(me(fast))
        assert found == 3 and read <= 3 * 5000
        assert scanned(me(plain))[1] >= read
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert player_trajectory(spark.read.parquet(fast), ["p-me"]).count() == 3
