"""Refresh of some days of a table, in steps that can be repeated after a crash.

1. The new rows of the requested days are staged as a table of their own, in their final form.
2. A row in the table's refresh log says that they are complete. From here on the refresh counts.
3. The swap brings the table to the staged state: new columns are added, the staged days replace
   the table's, and requested days that were not staged are dropped. Repeating it changes nothing.
4. A second row in the log says that it is done, and the staged table goes.

What stopped before 2 never happened; what stopped later is finished by ``finish_refreshes``, which
every refresh of the table calls first. One refresh of a table runs at a time. Readers may see the
swap half done, as with any overwrite of a plain Parquet table.
"""

from __future__ import annotations

import json
import operator
import uuid
from collections.abc import Iterable
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.operators.criteria import DateLike, Limits, as_day
from attempt_grid.sinks.tables import OVERWRITE_MODE, arranged
from attempt_grid.sources.attempts import validate_table_identifier

Days = Limits | Iterable[DateLike | None]

LOG_SCHEMA = "run_id string, state string, days string, replace_schema boolean, partition_col string, at timestamp"
STAGED, DONE = "staged", "done"
NO_DAY_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class _Requested:
    """The requested days: an interval, which holds no row without a day, or a list, which may name None."""

    def __init__(self, days: Days):
        self.limits = days if isinstance(days, Limits) else None
        self.listed = None if self.limits else {None if d is None else as_day(d) for d in days}

    def condition(self, column: str) -> Column:
        day = F.col(column)
        if self.limits:
            return reduce(operator.and_, self.limits.conditions(column, as_day), day.isNotNull())
        known = day.isNotNull() & day.isin([d for d in self.listed if d])
        return known | day.isNull() if None in self.listed else known

    def __contains__(self, day: date | None) -> bool:
        if self.listed is not None:
            return day in self.listed
        first, last = (None if end is None else as_day(end) for end in (self.limits.first, self.limits.last))
        return day is not None and (first is None or day >= first) and (last is None or day <= last)

    def as_text(self) -> str:
        plain = lambda d: None if d is None else as_day(d).isoformat()
        if self.limits:
            return json.dumps({"first": plain(self.limits.first), "last": plain(self.limits.last)})
        return json.dumps({"days": sorted(map(plain, self.listed), key=str)})

    @classmethod
    def of_text(cls, text: str) -> _Requested:
        found = json.loads(text)
        return cls(found["days"] if "days" in found else Limits(found["first"], found["last"]))


def requested_rows(rows: DataFrame, days: Days, partition_col: str = "partition_date") -> DataFrame:
    """The rows of the days; a day-partitioned input opens only those."""
    return rows.filter(_Requested(days).condition(partition_col))


def _qualified(spark: SparkSession, name: str) -> str:
    validate_table_identifier(name)
    return name if "." in name else f"{spark.catalog.currentDatabase()}.{name}"


def _log_table(name: str) -> str:
    return f"{name}__refreshes"


def _staged_table(name: str, run_id: str) -> str:
    return f"{name}__staged_{run_id}"


def partition_days(spark: SparkSession, name: str, partition_col: str = "partition_date") -> list[date | None]:
    """The days of a table's partitions, from the catalog alone; None is the partition of rows without a day."""
    names = [r[0].split("=", 1) for r in spark.sql(f"SHOW PARTITIONS {validate_table_identifier(name)}").collect()]
    return [None if value == NO_DAY_FOLDER else as_day(value) for column, value in names if column == partition_col]


def refresh_log(spark: SparkSession, name: str) -> DataFrame:
    """What was staged and what is done, run by run."""
    table = _log_table(_qualified(spark, name))
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], LOG_SCHEMA)


def _write_log(spark: SparkSession, name: str, run_id: str, state: str, days: str, replace_schema: bool, partition_col: str) -> None:
    row = (run_id, state, days, replace_schema, partition_col, datetime.now(timezone.utc))
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").saveAsTable(_log_table(name))


def _pending(spark: SparkSession, name: str) -> list:
    log = refresh_log(spark, name)
    done = log.filter(F.col("state") == DONE).select("run_id")
    return log.filter(F.col("state") == STAGED).join(done, "run_id", "left_anti").dropDuplicates(["run_id"]).orderBy("at").collect()


def _final_columns(df: DataFrame, table: DataFrame | None, partition_col: str, replace_schema: bool) -> list[Column]:
    """Columns of ``df`` by name, as the table will have them: its own in their order and type, then new ones.

    A value that its column's type cannot hold fails the job; a column that ``df`` lacks is NULL.
    """
    if table is None or replace_schema:
        return [F.col(c) for c in df.columns if c != partition_col] + [F.col(partition_col)]
    own, given = {f.name.lower(): f for f in table.schema}, {f.name.lower(): f for f in df.schema}
    taken = []
    for key, field in own.items():
        if key == partition_col.lower():
            continue
        if key not in given:
            taken.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif given[key].dataType == field.dataType:
            taken.append(F.col(given[key].name).alias(field.name))
        else:
            taken.append(F.col(given[key].name).cast(field.dataType).alias(field.name))
    new = [F.col(f.name) for key, f in given.items() if key not in own and key != partition_col.lower()]
    return [*taken, *new, F.col(partition_col)]


def _others_in_new_form(table: DataFrame, df: DataFrame, requested: _Requested, partition_col: str) -> DataFrame:
    """The table's rows of other days with the columns and types of ``df``; a value that does not fit fails the job."""
    own = {c.lower() for c in table.columns}
    columns = [(F.col(f.name) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
    return table.filter(~requested.condition(partition_col)).select(*columns)


def refresh_days(
    df: DataFrame,
    name: str,
    days: Days | None = None,
    *,
    partition_col: str = "partition_date",
    replace_schema: bool = False,
    cluster: bool = True,
    run_id: str | None = None,
) -> list[date | None] | Limits:
    """Replace the requested days of a day-partitioned table by ``df`` and return them.

    ``days`` is an interval or a list, in which None stands for rows without a day; a row of any
    other day fails the job before the table is touched. A requested day without rows ends up
    empty. Without ``days`` those that occur in ``df`` are replaced. A missing table is created.

    Columns go by name. New ones are added to the table, NULL on other days; missing ones are
    NULL; others are cast to the table's type, and a value that does not fit fails the job.
    ``replace_schema`` gives the table the columns and types of ``df`` instead, for which the
    other days are rewritten too.

    A refresh that is repeated with the same ``run_id`` after it was done does nothing.
    """
    spark = df.sparkSession
    name, run_id = _qualified(spark, name), run_id or uuid.uuid4().hex
    if not run_id.isalnum():
        raise ValueError("a run id consists of letters and digits")
    finish_refreshes(spark, name)
    if not refresh_log(spark, name).filter((F.col("run_id") == run_id) & (F.col("state") == DONE)).isEmpty():
        return days if isinstance(days, Limits) else list(days or ())
    table = spark.table(name) if spark.catalog.tableExists(name) else None
    rows, staged = df, _staged_table(name, run_id)
    if days is not None:
        days = days if isinstance(days, Limits) else list(days)
        found = F.coalesce(F.col(partition_col).cast("string"), F.lit("no day"))
        stray = F.raise_error(F.concat(F.lit("rows of a day that is not requested: "), found))
        rows = df.filter(F.when(_Requested(days).condition(partition_col), F.lit(True)).otherwise(stray.cast("boolean")))
    rows = rows.select(*_final_columns(rows, table, partition_col, replace_schema))
    # Left by a run that stopped before it was logged.
    spark.sql(f"DROP TABLE IF EXISTS {staged}")
    arranged(rows, partition_col, cluster).write.partitionBy(partition_col).saveAsTable(staged)
    if days is None:
        days = partition_days(spark, staged, partition_col)
    requested = _Requested(days)
    if replace_schema and table is not None:
        others = _others_in_new_form(table, rows, requested, partition_col)
        arranged(others, partition_col, cluster).write.mode("append").partitionBy(partition_col).saveAsTable(staged)
    _write_log(spark, name, run_id, STAGED, requested.as_text(), replace_schema, partition_col)
    finish_refreshes(spark, name)
    return days


def finish_refreshes(spark: SparkSession, name: str) -> list[str]:
    """Finish the refreshes of a table that were staged but not done, and return their run ids."""
    name = _qualified(spark, name)
    pending = _pending(spark, name)
    for entry in pending:
        _swap(spark, name, entry)
        _write_log(spark, name, entry["run_id"], DONE, entry["days"], entry["replace_schema"], entry["partition_col"])
        spark.sql(f"DROP TABLE IF EXISTS {_staged_table(name, entry['run_id'])}")
    return [entry["run_id"] for entry in pending]


def _swap(spark: SparkSession, name: str, entry) -> None:
    """Bring the table to the staged state. May be repeated at any point."""
    staged, column = _staged_table(name, entry["run_id"]), entry["partition_col"]
    fresh = spark.table(staged)
    if entry["replace_schema"] or not spark.catalog.tableExists(name):
        fresh.write.mode("overwrite").option("overwriteSchema", "true").partitionBy(column).saveAsTable(name)
        spark.catalog.refreshTable(name)
        return
    have = {c.lower() for c in spark.table(name).columns}
    added = [f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema if f.name.lower() not in have]
    if added:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(added)})")
    present, requested = set(partition_days(spark, staged, column)), _Requested.of_text(entry["days"])
    if present:
        # A session of its own, because the mode is a setting that others would take over.
        session = spark.newSession()
        session.conf.set(OVERWRITE_MODE, "dynamic")
        columns = ", ".join(f"`{c}`" for c in spark.table(name).columns)
        session.sql(f"INSERT OVERWRITE TABLE {name} ({columns}) SELECT {columns} FROM {staged}")
    emptied = [d for d in partition_days(spark, name, column) if d in requested and d not in present]
    if emptied:
        listed = ", ".join(f"PARTITION (`{column}` = {'NULL' if d is None else f"DATE'{d}'"})" for d in emptied)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {listed}")
    spark.catalog.refreshTable(name)
