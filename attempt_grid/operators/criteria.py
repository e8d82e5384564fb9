"""Row filters on attempts before aggregation and on statistics after it."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = str | date | datetime

# Names of the attempt groups and the order options are shown in.
FIRST_ATTEMPT = "1 attempt"
REPEAT_ATTEMPTS = "2+ attempts"
ATTEMPT_GROUPS = (FIRST_ATTEMPT, REPEAT_ATTEMPTS)

# Columns whose wanted values can be listed, and what may be listed for some of them.
VALUE_COLUMNS = {
    "payer_type": None,
    "traffic_type": None,
    "platform_name": None,
    "attempt_group": ATTEMPT_GROUPS,
    "super_ball": (True, False),
}


@dataclass(frozen=True, slots=True)
class Limits:
    """An interval with both ends included; an end that is None is open."""

    first: Any = None
    last: Any = None

    def conditions(self, column: str, convert: Callable[[Any], Any]) -> list[Column]:
        """What the column must fulfil, with the ends brought to its type."""
        low, high = (None if end is None else convert(end) for end in (self.first, self.last))
        if low is not None and high is not None and high < low:
            raise ValueError(f"{column} from {low} to {high} is empty")
        ends = ((low, operator.ge), (high, operator.le))
        return [compare(F.col(column), F.lit(end)) for end, compare in ends if end is not None]


@dataclass(frozen=True, slots=True)
class AttemptCriteria:
    """Which attempts or cells count: intervals of level buckets and days, and wanted values by
    column (any of ``VALUE_COLUMNS``). A column without listed values is not restricted."""

    levels: Limits = Limits()
    days: Limits = Limits()
    values: Mapping[str, Sequence] = field(default_factory=dict)


def as_day(value: DateLike) -> date:
    """Calendar day of a date, a datetime or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.fromisoformat(value.strip()).date()


def normalise_selection(selected: Iterable, all_options: Iterable) -> tuple:
    """The options that are selected, in option order; nothing when that leaves none out."""
    options, wanted = list(all_options), list(selected)
    kept = tuple(option for option in options if option in wanted)
    return kept if len(kept) < len(options) else ()


def ordered_range(first, second) -> tuple:
    """The two ends of a range, smaller one first."""
    return (second, first) if second < first else (first, second)


def date_range(selected, full: tuple[date, date]) -> tuple[date, date]:
    """The selected first and last day; while only one of them is picked, all days."""
    try:
        first, last = selected
    except (TypeError, ValueError):
        return full
    return first, last


def attempt_group() -> Column:
    """Name of the group an attempt number belongs to; NULL below one."""
    attempt = F.col("attempt")
    return F.when(attempt == 1, F.lit(FIRST_ATTEMPT)).when(
        attempt >= 2, F.lit(REPEAT_ATTEMPTS)
    )


def _known(selected: Iterable, allowed: Sequence, what: str) -> set:
    chosen = list(selected)
    for value in chosen:
        # 1 == True in Python, so the type has to agree as well.
        if not any(type(value) is type(option) and value == option for option in allowed):
            raise ValueError(f"{value!r} is no {what}, expected some of {allowed}")
    return set(chosen)


def _value_conditions(values: Mapping[str, Sequence], condensed: bool) -> Iterator[Column]:
    for column, wanted in values.items():
        if column not in VALUE_COLUMNS:
            raise ValueError(f"no values can be listed for {column!r}, only for {list(VALUE_COLUMNS)}")
        allowed = VALUE_COLUMNS[column]
        if allowed is None:
            if wanted:
                yield F.col(column).isin(list(wanted))
            continue
        chosen = _known(wanted, allowed, f"{column} value")
        if len(chosen) != 1:
            continue  # all of them or none: no condition, so that NULLs stay
        (only,) = chosen
        if column == "attempt_group" and not condensed:
            # on the number itself, so that the condition reaches the scan
            yield F.col("attempt") == 1 if only == FIRST_ATTEMPT else F.col("attempt") >= 2
        else:
            yield F.col(column) == F.lit(only)


def criteria_predicate(criteria: AttemptCriteria, *, condensed: bool = False) -> Column | None:
    """All conditions AND-ed into one predicate, None when there are none.

    ``condensed`` is for segment totals, which have an ``attempt_group`` instead of a number.
    """
    conditions = [
        *criteria.levels.conditions("level_cohort", int),
        *criteria.days.conditions("partition_date", as_day),
        *_value_conditions(criteria.values, condensed),
    ]
    return reduce(operator.and_, conditions) if conditions else None


def filter_attempts(
    attempts: DataFrame, criteria: AttemptCriteria, *, condensed: bool = False
) -> DataFrame:
    """Attempts (or, ``condensed``, segment totals) that meet every condition."""
    predicate = criteria_predicate(criteria, condensed=condensed)
    return attempts if predicate is None else attempts.filter(predicate)


def filter_cells(statistics: DataFrame, shown: AttemptCriteria) -> DataFrame:
    """Cells of grouped statistics (or metric values) inside the shown levels and days.

    Both are group keys, so on a lazy aggregate Catalyst moves the conditions below
    it and into the scan; on kept statistics they filter the small table.
    """
    if any(shown.values.values()):
        raise ValueError("cells have levels and days only; filter the attempts by values")
    conditions = [
        *shown.levels.conditions("level_group", int),
        *shown.days.conditions("date", as_day),
    ]
    return statistics.filter(reduce(operator.and_, conditions)) if conditions else statistics
