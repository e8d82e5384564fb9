"""Day-partitioned writes and results kept for reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKET_COLUMN = "level_cohort"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def arranged(df: DataFrame, partition_col: str, cluster: bool) -> DataFrame:
    """Rows arranged for a day-partitioned write.

    REBALANCE groups a day's rows, lets adaptive execution split a day that
    exceeds the advisory partition size and merges small ones. Inside a file the
    level buckets are sorted, so a level range skips row groups.
    """
    order = [partition_col, *([BUCKET_COLUMN] if BUCKET_COLUMN in df.columns else [])]
    grouped = df.hint("rebalance", partition_col) if cluster else df
    return grouped.sortWithinPartitions(*order)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_col: str = "partition_date",
    *,
    only_present_days: bool = False,
    cluster: bool = True,
) -> None:
    """Overwrite parquet files partitioned by day.

    ``only_present_days`` replaces just the days that occur in ``df``, which is
    what a daily refresh of a long history wants. ``cluster=False`` spares the
    shuffle where tasks hold few days anyway: events read from a day-partitioned
    table and joined by broadcast.
    """
    (
        arranged(df, partition_col, cluster)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_present_days else "static")
        .partitionBy(partition_col)
        .parquet(path)
    )


def write_lookup(
    df: DataFrame,
    path: str,
    key: str = "user_id",
    partition_col: str = "partition_date",
    *,
    keys_per_file: int = 100_000,
    row_group_bytes: int = 16 << 20,
) -> None:
    """Overwrite day-partitioned files in which single values of ``key`` are found fast.

    A day's rows are sorted by key, in small row groups with a Bloom filter on it. A condition on
    a few keys then opens the row groups that may hold them: within a file by its order, and no
    row group of the files that lack them. ``keys_per_file`` is how many different keys a row
    group is expected to hold at most; more make the filter less sharp, not wrong.
    """
    filters = {
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.expected.ndv#{key}": str(keys_per_file),
        "parquet.block.size": str(row_group_bytes),
    }
    rows = df.hint("rebalance", partition_col).sortWithinPartitions(partition_col, key)
    rows.write.mode("overwrite").options(**filters).partitionBy(partition_col).parquet(path)


def overwrite_table(
    df: DataFrame,
    name: str,
    partition_col: str = "partition_date",
    *,
    replace_schema: bool = False,
    cluster: bool = True,
) -> None:
    """Overwrite a catalog table partitioned by day; ``refresh_days`` replaces some days only.

    The schema options matter to table formats that check them: by default new
    columns are merged in, ``replace_schema`` puts the new schema in place.
    """
    writer = arranged(df, partition_col, cluster).write.mode("overwrite")
    if replace_schema:
        writer = writer.option("mergeSchema", "false").option("overwriteSchema", "true")
    else:
        writer = writer.option("mergeSchema", "true")
    writer.partitionBy(partition_col).saveAsTable(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach.")
    return f"{root.rstrip('/')}/attempt-grid-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a small result once and return it as read back.

    Grouped statistics are a few thousand cells out of any number of attempts.
    Written to the shared folder they outlive executors, and every later metric,
    display range and grid works on them instead of the attempts.
    """
    spark = df.sparkSession
    target = path or shared_folder(spark)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
