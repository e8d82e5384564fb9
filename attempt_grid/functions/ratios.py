"""Ratios that are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0.0 when there is no whole."""
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))
