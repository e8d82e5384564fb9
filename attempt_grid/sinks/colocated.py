"""Tables dealt into buckets by player, so that joins and windows by player need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attempt_grid.sources.attempts import validate_table_identifier

# Lets tables that share buckets of one column be joined on further columns without a shuffle.
# Off by default, because rows of a hot player then stay together; see ``join_outcomes_spread``.
COLOCATED_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_colocated(
    df: DataFrame,
    name: str,
    buckets: int,
    key: str = "user_id",
    order: tuple[str, ...] = ("client_time",),
    partition_col: str | None = None,
) -> None:
    """Overwrite a catalog table in ``buckets`` by the hash of ``key``, sorted by key and ``order``.

    Rows are shuffled here once, by the hash that buckets go by, so each bucket is written by one
    task, as one file (for each value of ``partition_col``). Tables with the same number of buckets
    are joined bucket by bucket. Choose the number for the largest of them, a bucket for every
    few hundred MB. Columns of ``order`` that the rows lack are skipped.
    """
    if buckets < 1:
        raise ValueError("a table has one bucket at least")
    sorted_by = [key, *(c for c in order if c in df.columns and c != key)]
    rows = df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(*sorted_by)
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.saveAsTable(validate_table_identifier(name))
