"""Spark-native analytics over level attempts: mart build, statistics and grids."""

from attempt_grid.operators.contract import (
    ATTEMPT_COLUMNS,
    ATTEMPT_SCHEMA,
    ContractCounts,
    ContractError,
    canonical_sort,
    contract_rejects,
    read_accepted,
    read_rejected,
    to_contract,
    write_checked,
)
from attempt_grid.operators.criteria import (
    AttemptCriteria,
    Limits,
    criteria_predicate,
    filter_attempts,
    filter_cells,
    normalise_selection,
)
from attempt_grid.operators.grid import (
    block_columns,
    block_records,
    cell_details,
    clamp_values,
    dense_grid,
    duplicate_cells,
    grid_blocks,
    grid_records,
    mask_low_samples,
    pivot_grid,
    value_bounds,
)
from attempt_grid.operators.metrics import (
    METRICS,
    metric_methods,
    metric_names,
    select_metric,
    select_metric_values,
)
from attempt_grid.operators.options import (
    FilterOptions,
    distinct_values,
    filter_options,
    offered_values,
    read_filter_options,
    read_segment_options,
    segment_options,
)
from attempt_grid.operators.segment_runs import compact_runs, merged_segments, read_runs, segment_deltas, write_run
from attempt_grid.operators.statistics import (
    STATISTIC_COLUMNS,
    aggregate_statistics,
    segment_totals,
    statistics_from_segments,
)
from attempt_grid.operators.status import ProjectTable, dataset_status, latest_partition
from attempt_grid.plans.grid_request import GridRequest, grid_cells, grid_cells_from_segments, metric_cells
from attempt_grid.plans.mart import attempts_from_outcomes, attempts_from_payload, rebuild_table
from attempt_grid.plans.refresh import ProjectBuild, refresh
from attempt_grid.session import attempt_session
from attempt_grid.sinks.colocated import COLOCATED_SETTINGS, write_colocated
from attempt_grid.sinks.day_refresh import finish_refreshes, refresh_days, refresh_log
from attempt_grid.sinks.tables import keep, overwrite_table, write_lookup, write_partitioned
from attempt_grid.sources.attempts import (
    ProjectSource,
    load_attempts,
    read_attempts_csv,
    read_attempts_projected,
    read_attempts_sql,
    read_attempts_table,
    source_registry,
)
from attempt_grid.sources.csv_records import read_attempts_csv_parts, read_csv_records
