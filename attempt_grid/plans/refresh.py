"""The daily run: rebuild what was asked for, report on everything."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attempt_grid.operators.statistics import segment_totals
from attempt_grid.operators.status import ProjectTable, dataset_status
from attempt_grid.plans.mart import rebuild_table
from attempt_grid.sinks.day_refresh import Days, refresh_days, requested_rows
from attempt_grid.sinks.tables import overwrite_table
from attempt_grid.sources.attempts import read_attempts_table


@dataclass(frozen=True, slots=True)
class ProjectBuild:
    """A project's attempt table and how to build it.

    ``build`` is only called when a rebuild is requested. ``replace_schema``, ``cluster``,
    ``only_present_days`` and ``days`` are passed on to the write. With ``days``, those the build
    was asked for, the rest of the table stays and a day that is now empty loses its old rows;
    ``only_present_days`` replaces the days that occur. ``segment_table`` is kept up to date with
    the ``segment_totals`` of what was built.
    """

    project: str
    table_name: str
    build: Callable[[], DataFrame]
    requested: bool = False
    replace_schema: bool = False
    cluster: bool = True
    only_present_days: bool = False
    segment_table: str | None = None
    days: Days | None = None


def refresh(spark: SparkSession, builds: Iterable[ProjectBuild]) -> DataFrame:
    """Rebuild the requested tables one after the other, then return the status of all."""
    builds = list(builds)
    for item in builds:
        if item.requested:
            options = {"replace_schema": item.replace_schema, "cluster": item.cluster}
            replaced = rebuild_table(
                item.build(), item.table_name, only_present_days=item.only_present_days, days=item.days, **options
            )
            if item.segment_table:
                attempts = read_attempts_table(spark, item.table_name)
                if replaced is None:
                    overwrite_table(segment_totals(attempts), item.segment_table, **options)
                else:
                    # the segments of the same days, also where none are left
                    rows = requested_rows(attempts, replaced)
                    refresh_days(segment_totals(rows), item.segment_table, replaced, **options)
    return dataset_status(
        spark, [ProjectTable(b.project, b.table_name, b.requested) for b in builds]
    )
