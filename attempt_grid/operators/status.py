"""Freshness of attempt tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.sources.attempts import validate_table_identifier

# Fixed value: status text of a table that cannot be read.
UNAVAILABLE = "недоступно"


@dataclass(frozen=True, slots=True)
class ProjectTable:
    """A project's attempt table and whether this run was asked to rebuild it."""

    project: str
    table_name: str
    rebuild_requested: bool = False


def latest_partition(attempts: DataFrame, column: str = "partition_date") -> DataFrame:
    """One row with the last partition day; reads no data columns on a partitioned table."""
    return attempts.agg(F.max(column).alias("latest_partition"))


def _listed_days(spark: SparkSession, table_name: str, column: str) -> list | None:
    """Partition days of a catalog table, newest first; None when the catalog lists none."""
    try:
        listed = spark.sql(f"SHOW PARTITIONS {validate_table_identifier(table_name)}")
    except (AnalysisException, ValueError):
        return None
    day = F.regexp_extract("partition", rf"(?:^|/){column}=([^/]*)", 1).try_cast("date")
    days = listed.select(day.alias("day")).filter(F.col("day").isNotNull()).distinct()
    return [row["day"] for row in days.orderBy(F.desc("day")).collect()]


def latest_partition_of_table(
    spark: SparkSession, table_name: str, column: str = "partition_date"
) -> date | None:
    """Last partition day of a table that holds a row.

    Where the catalog lists the partitions, only the newest one is opened (older
    ones if it turns out empty) instead of every file of the table. Starts jobs.
    """
    table = spark.table(table_name)
    for day in _listed_days(spark, table_name, column) or ():
        if not table.filter(F.col(column) == F.lit(day)).isEmpty():
            return day
    return latest_partition(table, column).first()["latest_partition"]


def _latest_or_reason(spark: SparkSession, table_name: str, column: str) -> str | None:
    try:
        last = latest_partition_of_table(spark, table_name, column)
    except Exception as error:  # any unreadable table is a status, not a failure
        return f"{UNAVAILABLE}: {type(error).__name__}"
    return None if last is None else str(last)


def dataset_status(
    spark: SparkSession, tables: Iterable[ProjectTable], column: str = "partition_date"
) -> DataFrame:
    """One row per project: table, rebuild flag and last partition or why there is none.

    Reads every table a little, because a broken table only shows when read.
    """
    rows = []
    for table in tables:
        latest = _latest_or_reason(spark, table.table_name, column)
        rows.append((table.project, table.table_name, table.rebuild_requested, latest))
    return spark.createDataFrame(
        rows,
        "project string, table_name string, rebuild_requested boolean, latest_partition string",
    )
