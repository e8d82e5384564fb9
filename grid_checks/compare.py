"""Compare every Spark query with its DuckDB counterpart.

    python -m grid_checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from attempt_grid import attempt_session
from grid_checks.duckdb_queries import ORACLE
from grid_checks.spark_queries import QUERIES


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process DuckDB with one view per sample table."""
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def as_rows(columns: list[str], rows: list) -> Counter:
    """Rows as a multiset, columns in name order. Values are compared exactly."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, connection, sf_dir: str, name: str) -> str | None:
    """What differs between the two engines, None when nothing does."""
    frame = QUERIES[name](spark, sf_dir)
    found = frame.collect()
    # As a view, because not every statement that runs can be stored as one.
    connection.execute(f"CREATE OR REPLACE VIEW compared AS {ORACLE[name]}")
    cursor = connection.execute("SELECT * FROM compared")
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(set(columns) ^ set(frame.columns))}"
    left, right = as_rows(frame.columns, found), as_rows(columns, expected)
    if left != right:
        extra, lacking = list((left - right).items()), list((right - left).items())
        return f"{len(found)} vs {len(expected)} rows; only Spark {extra[:2]}; only DuckDB {lacking[:2]}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = attempt_session(settings={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = duckdb_views(sf_dir), 0
    for name in names:
        start = time.perf_counter()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.perf_counter() - start:.2f}s {problem or ''}")
    print(f"{len(names) - failed} of {len(names)} agree; without SQL: {sorted(set(QUERIES) - set(ORACLE))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
