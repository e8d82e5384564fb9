"""Time the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each query is run once to warm up, then timed; its result
is materialised with the noop sink and the median is reported.

``*_from_files`` queries start at the sample tables, joins and derived columns
included. The table builds read raw events stored by day; the other queries read
the attempt table that ``write_attempts`` wrote.
"""

from __future__ import annotations

import json
import os
import statistics as stats
import tempfile
import time
from pathlib import Path

from attempt_grid import (
    AttemptCriteria,
    Limits,
    GridRequest,
    aggregate_statistics,
    attempt_session,
    attempts_from_outcomes,
    attempts_from_payload,
    dense_grid,
    filter_cells,
    filter_options,
    grid_cells,
    keep,
    pivot_grid,
    segment_totals,
    select_metric,
    statistics_from_segments,
    write_partitioned,
)
from attempt_grid.operators.contract import to_contract
from attempt_grid.sinks.tables import shared_folder
from grid_checks import sample_tables as sample
from grid_checks.spark_queries import BUCKET_WIDTH, CUTOFF, QUERIES, SEVERAL_CONDITIONS


def timed(action, runs: int) -> float:
    action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(stats.median(seconds), 4)


def noop(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def stored(frame):
    """The frame as a table partitioned by day, the way raw events are kept."""
    folder = shared_folder(frame.sparkSession)
    write_partitioned(frame, folder)
    return frame.sparkSession.read.parquet(folder)


def table_builds(spark, sf_dir: str) -> dict:
    """Both attempt table builds over stored raw tables."""
    players = keep(sample.players_from_customer(spark, sf_dir))
    outcomes = stored(sample.outcomes_from_events(spark, sf_dir))
    rules = {"bucket_width": BUCKET_WIDTH, "cutoff": CUTOFF}
    loose, chained = (
        stored(sample.levels_from_events(spark, sf_dir, chained=chained))
        for chained in (False, True)
    )
    return {
        "mart_a": attempts_from_payload(loose, players, **rules),
        "mart_b": attempts_from_outcomes(chained, players, outcomes, **rules),
    }


def main(folder: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = attempt_session(
        "attempt-grid-bench",
        {
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.checkpoint.dir": folder,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    table = shared_folder(spark)
    source = sample.attempts_from_lineitem(spark, sf_dir)
    queries = {"write_attempts": timed(lambda: write_partitioned(source, table), 1)}

    attempts = to_contract(spark.read.parquet(table), trim_text=False)
    segments = keep(segment_totals(attempts))
    kept = keep(aggregate_statistics(attempts, ordered=False))
    fail_rate = select_metric(kept, "fail_rate", "relative", min_observations=30)
    shown = AttemptCriteria(levels=Limits(3, 120), days=Limits("1996-01-01", "1998-06-30"))
    same_range = AttemptCriteria(levels=Limits(3, 120), days=Limits("1996-01-01", "1998-06-30"))
    request = GridRequest("fail_rate", "relative", min_observations=30)
    frames = {
        "stats_all": aggregate_statistics(attempts),
        "stats_filtered": aggregate_statistics(attempts, SEVERAL_CONDITIONS),
        "stats_filtered_from_segments": statistics_from_segments(segments, SEVERAL_CONDITIONS),
        "options_one_pass": filter_options(attempts),
        "grid_request": grid_cells(attempts, request),
        "display_recomputed": aggregate_statistics(attempts, same_range),
        "display_filter": filter_cells(kept, shown),
        "grid_pivot": pivot_grid(fail_rate),
        "grid_dense": dense_grid(fail_rate),
        "stats_all_from_files": QUERIES["stats_all"](spark, sf_dir),
        "contract_rejects_from_files": QUERIES["contract_rejects"](spark, sf_dir),
        **table_builds(spark, sf_dir),
    }
    for name, frame in frames.items():
        queries[name] = timed(lambda frame=frame: noop(frame), runs)

    print(
        json.dumps(
            {
                "metric": "attempt_grid_total",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        main(shared)
