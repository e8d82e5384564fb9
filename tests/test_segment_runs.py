import random
from datetime import date

import pytest
from grid_rows import attempt

from attempt_grid import AttemptCriteria, GridRequest, grid_cells, grid_cells_from_segments, segment_totals, statistics_from_segments, aggregate_statistics
from attempt_grid.operators.segment_runs import compact_runs, merged_segments, read_runs, segment_deltas, write_run


def some_attempts(n, seed=1):
    draw, rows = random.Random(seed), []
    for i in range(n):
        kind = draw.choice(["FW", "CW", "CF", "FF", None])
        flags = {name: draw.choice([int(name == kind), int(name == kind), None]) for name in ("FW", "CW", "CF", "FF")}
        rows.append(
            attempt(
                user_id=f"u{i}", partition_date=draw.choice([date(2026, 1, 1 + d) for d in range(4)] + [None]),
                level_cohort=draw.choice([1, 2, None]), payer_type=draw.choice(["payer", "nonpayer"]),
                attempt=draw.choice([1, 2, 3, None]), failed=draw.choice([0, 1]), super_ball=draw.choice([True, False, None]), **flags,
            )
        )
    return rows


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def same(spark, path, frame):
    """The merged runs are the totals of the attempts, in schema as well."""
    merged, whole = merged_segments(read_runs(spark, path)), segment_totals(frame)
    assert rows_of(merged) == rows_of(whole)
    assert sorted(merged.columns) == sorted(whole.columns)
    request = GridRequest("fail_rate", "relative", min_observations=3)
    assert rows_of(grid_cells_from_segments(merged, request)) == rows_of(grid_cells(frame, request))
    criteria = AttemptCriteria(values={"payer_type": ["payer"]})
    assert rows_of(statistics_from_segments(merged, criteria)) == rows_of(aggregate_statistics(frame, criteria))


def test_late_repeated_and_withdrawn_rows(spark, attempts, tmp_path):
    path, rows = str(tmp_path / "runs"), some_attempts(400)
    first, late, gone = rows[:250], rows[250:], rows[100:160] + rows[300:330]
    write_run(segment_deltas(attempts(*first)), path, "2026-01-05")
    same(spark, path, attempts(*first))
    # a late run is repeated after it had written something else
    write_run(segment_deltas(attempts(*rows[200:210])), path, "2026-01-06")
    for _ in range(2):
        write_run(segment_deltas(attempts(*late)), path, "2026-01-06")
    same(spark, path, attempts(*rows))
    write_run(segment_deltas(withdrawn=attempts(*gone)), path, "2026-01-07")
    left = [r for r in rows if r not in gone]
    same(spark, path, attempts(*left))
    # the withdrawal itself is taken back
    write_run(segment_deltas(attempts(), attempts()), path, "2026-01-07")
    same(spark, path, attempts(*rows))


def test_corrected_rows(spark, attempts, tmp_path):
    path, rows = str(tmp_path / "runs"), some_attempts(60, 2)
    right = [dict(r, payer_type="payer", failed=1) for r in rows[:20]]
    write_run(segment_deltas(attempts(*rows)), path, "one")
    write_run(segment_deltas(attempts(*right), attempts(*rows[:20])), path, "two")
    same(spark, path, attempts(*right, *rows[20:]))


def test_everything_withdrawn_leaves_nothing(spark, attempts, tmp_path):
    path, rows = str(tmp_path / "runs"), some_attempts(30, 3)
    write_run(segment_deltas(attempts(*rows)), path, "1")
    write_run(segment_deltas(withdrawn=attempts(*rows)), path, "2")
    assert merged_segments(read_runs(spark, path)).count() == 0
    assert segment_deltas(attempts(*rows), attempts(*rows)).count() == 0


def test_withdrawing_what_was_never_counted_fails(spark, attempts, tmp_path):
    path, rows = str(tmp_path / "runs"), some_attempts(10, 4)
    write_run(segment_deltas(attempts(*rows[:9])), path, "1")
    write_run(segment_deltas(withdrawn=attempts(*rows)), path, "2")
    with pytest.raises(Exception, match="more attempts withdrawn"):
        merged_segments(read_runs(spark, path)).collect()


def test_condensed_runs_say_the_same(spark, attempts, tmp_path):
    path, into, rows = str(tmp_path / "runs"), str(tmp_path / "condensed"), some_attempts(120, 5)
    for n, at in enumerate(range(0, 120, 30)):
        write_run(segment_deltas(attempts(*rows[at : at + 30])), path, f"run-{n}")
    write_run(segment_deltas(withdrawn=attempts(*rows[:5])), path, "run-9")
    for _ in range(2):
        compact_runs(spark, path, into, "base")
    same(spark, into, attempts(*rows[5:]))
    write_run(segment_deltas(attempts(*rows[:5])), into, "run-10")
    same(spark, into, attempts(*rows))
    with pytest.raises(ValueError):
        compact_runs(spark, into, into, "base")


def test_bad_run_ids(attempts, tmp_path):
    for bad in ("", "a/b", "x" * 101):
        with pytest.raises(ValueError):
            write_run(segment_deltas(attempts()), str(tmp_path / "runs"), bad)
    with pytest.raises(ValueError):
        segment_deltas()
