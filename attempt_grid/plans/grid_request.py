"""From attempts to the cells of one displayed grid."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from attempt_grid.operators import grid
from attempt_grid.operators.criteria import AttemptCriteria, filter_cells
from attempt_grid.operators.metrics import select_metric
from attempt_grid.operators.options import FilterOptions, read_filter_options
from attempt_grid.operators.statistics import aggregate_statistics, statistics_from_segments
from attempt_grid.sources.attempts import ProjectSource, load_attempts


@dataclass(frozen=True, slots=True)
class GridRequest:
    """What one grid shows: which attempts, which metric, which cells."""

    metric: str
    method: str
    min_observations: int = 0
    criteria: AttemptCriteria = field(default_factory=AttemptCriteria)
    shown: AttemptCriteria = field(default_factory=AttemptCriteria)


def project_options(
    spark: SparkSession, registry: Mapping[str, ProjectSource], project: str
) -> FilterOptions:
    """Filter bounds and values of a project: one scan, one row fetched."""
    return read_filter_options(load_attempts(spark, registry, project))


def project_statistics(
    spark: SparkSession,
    registry: Mapping[str, ProjectSource],
    project: str,
    criteria: AttemptCriteria | None = None,
) -> DataFrame:
    """Grouped statistics of a project. Wrap in ``keep`` to serve several requests."""
    return aggregate_statistics(load_attempts(spark, registry, project), criteria)


def metric_cells(statistics: DataFrame, request: GridRequest) -> DataFrame:
    """The requested metric on the shown cells, from statistics of the same criteria."""
    values = select_metric(
        statistics, request.metric, request.method, min_observations=request.min_observations
    )
    return filter_cells(values, request.shown)


def grid_cells(attempts: DataFrame, request: GridRequest) -> DataFrame:
    """Attempts to masked cells in one lazy plan with one shuffle."""
    statistics = aggregate_statistics(attempts, request.criteria, ordered=False)
    return grid.mask_low_samples(metric_cells(statistics, request))


def grid_cells_from_segments(segments: DataFrame, request: GridRequest) -> DataFrame:
    """The same cells from ``segment_totals``, without going back to the attempts."""
    statistics = statistics_from_segments(segments, request.criteria, ordered=False)
    return grid.mask_low_samples(metric_cells(statistics, request))
