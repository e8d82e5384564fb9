"""Selectable metrics over grouped statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True, slots=True)
class Metric:
    """A selectable metric: a statistic column with its numerator and sample size."""

    name: str
    method: str
    numerator: str | None
    sample: str

    @property
    def value(self) -> str:
        """Statistic column that holds the metric."""
        return f"{self.name}_{self.method}"

    @property
    def is_share(self) -> bool:
        """Whether the value is a percentage, whose reliability depends on the sample."""
        return self.method in ("relative", "partial_relative")


# Selectable metrics in the order they are offered.
METRICS = (
    Metric("CF", "absolute", "CF_absolute", "attempts_absolute"),
    Metric("CW", "absolute", "CW_absolute", "attempts_absolute"),
    Metric("FF", "absolute", "FF_absolute", "attempts_absolute"),
    Metric("FW", "absolute", "FW_absolute", "attempts_absolute"),
    Metric("CF", "relative", "CF_absolute", "attempts_absolute"),
    Metric("CW", "relative", "CW_absolute", "attempts_absolute"),
    Metric("FF", "relative", "FF_absolute", "attempts_absolute"),
    Metric("FW", "relative", "FW_absolute", "attempts_absolute"),
    Metric("CF", "partial_relative", "CF_absolute", "fails_absolute"),
    Metric("CW", "partial_relative", "CW_absolute", "wins_absolute"),
    Metric("FF", "partial_relative", "FF_absolute", "fails_absolute"),
    Metric("FW", "partial_relative", "FW_absolute", "wins_absolute"),
    Metric("attempt", "average", None, "attempts_absolute"),
    Metric("failed", "absolute", "failed_absolute", "attempts_absolute"),
    Metric("wins", "absolute", "wins_absolute", "attempts_absolute"),
    Metric("fail_rate", "relative", "failed_absolute", "attempts_absolute"),
    Metric("win_rate", "relative", "wins_absolute", "attempts_absolute"),
)

VALUE_COLUMNS = ("level_group", "date", "value", "metric_name", "calculation_method")
CONTEXT_COLUMNS = (*VALUE_COLUMNS, "value_count", "sample_count", "is_low_sample")

_BY_KEY = {(metric.name, metric.method): metric for metric in METRICS}


def metric_names() -> list[str]:
    """Names a user can choose from, in offered order."""
    return list(dict.fromkeys(metric.name for metric in METRICS))


def metric_methods(name: str) -> list[str]:
    """Calculation methods one metric name has, in offered order."""
    return [metric.method for metric in METRICS if metric.name == name]


def find_metric(name: str, method: str) -> Metric:
    """The metric of a name and method; unknown pairs raise."""
    try:
        return _BY_KEY[name, method]
    except KeyError:
        raise ValueError(
            f"{name!r} has no {method!r} metric, only {metric_methods(name)}"
        ) from None


def select_metric(
    statistics: DataFrame, name: str, method: str, *, min_observations: int = 0
) -> DataFrame:
    """One metric per cell with its numerator, sample size and low-sample flag.

    Only percentages can be low-sample. A metric without a numerator reports its
    own value as the count.
    """
    metric = find_metric(name, method)
    value, sample = F.col(metric.value), F.col(metric.sample)
    numerator = value if metric.numerator is None else F.col(metric.numerator)
    too_few = (sample < F.lit(min_observations)) if metric.is_share else F.lit(False)
    return statistics.select(
        F.col("level_group").cast("int").alias("level_group"),
        "date",
        value.cast("double").alias("value"),
        F.lit(metric.name).alias("metric_name"),
        F.lit(metric.method).alias("calculation_method"),
        numerator.cast("double").alias("value_count"),
        sample.cast("double").alias("sample_count"),
        too_few.alias("is_low_sample"),
    )


def select_metric_values(statistics: DataFrame, name: str, method: str) -> DataFrame:
    """One metric per cell, without reliability context."""
    return select_metric(statistics, name, method).select(*VALUE_COLUMNS)
