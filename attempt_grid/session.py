"""A session with the settings the operators are designed for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# Adaptive execution merges small shuffle partitions, so their initial number can
# be sized for the largest stage; it also splits skewed joins and hot days.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}

SHUFFLE_PARTITION_BYTES = 128 << 20


def attempt_session(
    app_name: str = "attempt-grid",
    settings: Mapping[str, str] | None = None,
    *,
    input_bytes: int | None = None,
) -> SparkSession:
    """The active or a new session with these settings; yours take precedence.

    ``input_bytes`` is the size of the largest input that is shuffled. It sets the initial
    number of shuffle partitions, one for every 128 MB and 200 at least.
    """
    sized = {}
    if input_bytes is not None:
        initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        sized[initial] = str(max(200, -(-input_bytes // SHUFFLE_PARTITION_BYTES)))
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **sized, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
