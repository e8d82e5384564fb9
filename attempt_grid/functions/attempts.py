"""Derived columns of one level attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attempt_grid.functions.casts import whole_number

# Outcome flag columns and the segment name each one stands for,
# in the order in which a set flag wins.
OUTCOME_SEGMENTS = {
    "FW": "far_win",
    "CW": "close_win",
    "CF": "close_fail",
    "FF": "far_fail",
}
UNKNOWN_SEGMENT = "unknown"

# Fixed value: level ids look like st00120; leading zeros are not part of the number.
LEVEL_ID_PATTERN = "st0*([0-9]+)"


def indicator(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def level_number(level_id: Column) -> Column:
    """Numeric part of a level id, NULL when the text has none."""
    return F.regexp_extract(level_id, LEVEL_ID_PATTERN, 1).try_cast("int")


def level_bucket(level: Column, width: float) -> Column:
    """Bucket number of a level; NULL levels have no bucket, negative ones round down."""
    if not width > 0:
        raise ValueError(f"bucket width must be positive, got {width!r}")
    return F.floor(level / F.lit(float(width))).cast("int")


def is_first_attempt(attempt: Column, source: T.DataType) -> Column:
    """1 for attempt number one; missing or unreadable numbers give 0."""
    return indicator(whole_number(attempt, source) == 1)


def segment_flags(segment: Column) -> dict[str, Column]:
    """One 0/1 column per outcome; an unknown segment sets none of them."""
    return {flag: indicator(segment == name) for flag, name in OUTCOME_SEGMENTS.items()}


def flags_segment() -> Column:
    """Segment name of the first outcome flag that is set."""
    names = [F.when(F.col(flag) == 1, F.lit(name)) for flag, name in OUTCOME_SEGMENTS.items()]
    return F.coalesce(*names, F.lit(UNKNOWN_SEGMENT))
