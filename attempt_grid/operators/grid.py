"""Level x day grids: long and wide shape, reliability mask, colour range."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attempt_grid.operators.criteria import DateLike, as_day, ordered_range
from attempt_grid.operators.statistics import CELL_KEYS

# Reliability labels of a cell.
LOW_SAMPLE_LABEL = "мало данных"
ENOUGH_LABEL = "достаточно"

DUPLICATE_CELL = "a grid has at most one row per level_group and date, this input repeats a cell"
NO_DAY = "a grid cell needs a day, this input has cells whose date is NULL"
UNLISTED_DAY = "this input has cells on days that are not listed; filter_cells selects days"


def duplicate_cells(values: DataFrame) -> DataFrame:
    """Cells that occur more than once, with their row count."""
    return (
        values.groupBy(*CELL_KEYS)
        .agg(F.count(F.lit(1)).alias("cell_rows"))
        .filter(F.col("cell_rows") > 1)
    )


def require_unique_cells(values: DataFrame) -> DataFrame:
    """The values unchanged, or an error when a cell is not unique. Starts one job."""
    if not duplicate_cells(values).isEmpty():
        raise ValueError(DUPLICATE_CELL)
    return values


def grid_days(values: DataFrame) -> list[date]:
    """Days of the grid, ascending. Starts one job and fetches one row per day."""
    days = [row["date"] for row in values.select("date").distinct().collect()]
    if None in days:
        raise ValueError(NO_DAY)
    return sorted(days)


def _on_listed_days(values: DataFrame, days: list[date]) -> DataFrame:
    """The values; the job that reads a cell without a day or on another day fails."""
    day = F.col("date").cast("date")
    listed = day.isin(days) if days else F.lit(False)
    fail = lambda text: F.raise_error(text).cast("boolean")
    return values.filter(F.when(day.isNull(), fail(NO_DAY)).when(~listed, fail(UNLISTED_DAY)).otherwise(F.lit(True)))


def pivot_grid(
    values: DataFrame,
    days: Iterable[DateLike] | None = None,
    value: str = "value",
    *,
    ordered: bool = True,
) -> DataFrame:
    """Long cells as a wide grid: one row per level bucket, one column per ISO day.

    Nothing is aggregated: a duplicate cell fails the job that computes it, and so
    does a cell without a day or on a day that is not in ``days``. The days become
    columns, so they have to be known; without ``days`` one job looks them up.
    Beyond a few hundred days prefer ``dense_grid``.
    """
    missing = sorted({*CELL_KEYS, value} - set(values.columns))
    if missing:
        raise ValueError(f"grid values need the columns {', '.join(missing)}")
    cells = values.select(
        F.col("level_group").cast("int").alias("level_group"),
        F.col("date").cast("date").alias("date"),
        F.col(value).cast("double").alias("value"),
    )
    columns = sorted({as_day(d) for d in days}) if days is not None else grid_days(cells)
    cells = _on_listed_days(cells, columns)
    only_value = F.when(F.count(F.lit(1)) == 1, F.first("value")).otherwise(
        F.raise_error(DUPLICATE_CELL).cast("double")
    )
    if not columns:
        return cells.select("level_group").distinct()
    wide = cells.groupBy("level_group").pivot("date", columns).agg(only_value)
    # Name the day columns explicitly: they are part of the result's schema.
    wide = wide.toDF("level_group", *[d.isoformat() for d in columns])
    return wide.orderBy("level_group") if ordered else wide


def grid_records(wide: DataFrame, *, ordered: bool = True) -> DataFrame:
    """A wide grid as long records without its empty cells."""
    days = [name for name in wide.columns if name != "level_group"]
    if not days:
        return wide.select(
            F.col("level_group").cast("int").alias("level_group"),
            F.lit(None).cast("date").alias("date"),
            F.lit(None).cast("double").alias("value"),
        ).filter(F.lit(False))
    long = wide.unpivot("level_group", days, "day", "value")
    records = long.filter(F.col("value").isNotNull()).select(
        F.col("level_group").cast("int").alias("level_group"),
        F.col("day").cast("date").alias("date"),
        F.col("value").cast("double").alias("value"),
    )
    return records.orderBy(*CELL_KEYS) if ordered else records


BLOCK_DAYS = 366


def grid_blocks(values: DataFrame, value: str = "value", block_days: int = BLOCK_DAYS) -> DataFrame:
    """A wide grid in blocks of days: level_group, first_day, and the values of ``block_days`` days as an array.

    Blocks start at multiples of ``block_days`` from 1970-01-01. The plan has the same size for any
    number of days, and no day has to be known before. A cell that occurs twice or has no day
    fails the job. Levels without a value in a block have no row for it.
    """
    if block_days < 1:
        raise ValueError("a block has one day at least")
    cells = values.select(
        F.col("level_group").cast("int").alias("level_group"),
        F.unix_date(F.col("date").cast("date")).alias("day"),
        F.col(value).cast("double").alias("value"),
    )
    day = F.when(F.col("day").isNull(), F.raise_error(NO_DAY).cast("int")).otherwise(F.col("day"))
    only_value = F.when(F.count(F.lit(1)) == 1, F.first("value")).otherwise(F.raise_error(DUPLICATE_CELL).cast("double"))
    block = F.floor(F.col("day") / F.lit(block_days)).cast("int")
    unique = cells.withColumn("day", day).groupBy("level_group", "day").agg(only_value.alias("value"))
    found = F.map_from_entries(F.collect_list(F.struct((F.col("day") - block * block_days).alias("offset"), "value")))
    blocks = unique.groupBy("level_group", block.alias("block")).agg(found.alias("found"))
    offsets = F.sequence(F.lit(0), F.lit(block_days - 1))
    return blocks.select(
        "level_group",
        F.date_from_unix_date(F.col("block") * block_days).alias("first_day"),
        F.transform(offsets, lambda i: F.element_at("found", i)).alias("values"),
    )


def block_records(blocks: DataFrame) -> DataFrame:
    """The blocks of ``grid_blocks`` as long records without their empty cells."""
    cells = blocks.select("level_group", "first_day", F.posexplode("values").alias("offset", "value"))
    return cells.filter(F.col("value").isNotNull()).select(
        "level_group", F.date_add("first_day", F.col("offset")).alias("date"), "value"
    )


def block_columns(blocks: DataFrame, first: DateLike, last: DateLike, *, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Some days of the blocks as columns, as in ``pivot_grid``: what a screen shows of a long grid."""
    first, last = as_day(first), as_day(last)
    if last < first:
        raise ValueError(f"days from {first} to {last} are none")
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    offset = lambda day: F.datediff(F.lit(day), "first_day")
    near = (F.col("first_day") > F.date_sub(F.lit(first), block_days)) & (F.col("first_day") <= F.lit(last))
    here = [F.max(F.when(offset(d).between(0, block_days - 1), F.get("values", offset(d)))).alias(d.isoformat()) for d in days]
    return blocks.filter(near).groupBy("level_group").agg(*here).orderBy("level_group")


def dense_grid(values: DataFrame, days: Iterable[DateLike] | None = None) -> DataFrame:
    """Every level bucket on every day; cells that did not exist carry NULLs.

    One grouping by level bucket, no join: a bucket's cells (at most one per day)
    are completed with the days it lacks. Without ``days`` the days come from the
    values themselves, which reads them a second time; run it on kept statistics.
    The job fails on a cell that occurs twice, that has no day, or whose day is not
    in ``days``.
    """
    rest = [name for name in values.columns if name not in CELL_KEYS]
    cell = F.struct("date", *rest)
    if days is None:
        found = values.select("date").distinct().agg(F.sort_array(F.collect_list("date")))
        every_day = found.scalar()
        no_day = F.raise_error(NO_DAY).cast("boolean")
        values = values.filter(F.when(F.col("date").isNull(), no_day).otherwise(F.lit(True)))
    else:
        wanted = sorted({as_day(d) for d in days})
        every_day = F.array(*[F.lit(d) for d in wanted]).cast("array<date>")
        values = _on_listed_days(values, wanted)
    repeated = F.size("cells") > F.size(F.array_distinct(F.transform("cells", lambda c: c["date"])))
    unique = F.when(repeated, F.raise_error(DUPLICATE_CELL).cast("boolean")).otherwise(F.lit(True))
    levels = (
        values.groupBy("level_group")
        .agg(F.collect_list(cell).alias("cells"))
        .filter(unique)
        .withColumn("every_day", every_day)
    )
    absent = F.array_except("every_day", F.transform("cells", lambda c: c["date"]))
    blanks = [F.lit(None).cast(values.schema[name].dataType).alias(name) for name in rest]
    padding = F.transform(absent, lambda d: F.struct(d.alias("date"), *blanks))
    return levels.select("level_group", F.inline(F.concat("cells", padding)))


def mask_low_samples(cells: DataFrame) -> DataFrame:
    """Adds ``visible_value``: the value, hidden in cells flagged as low-sample."""
    hidden = F.coalesce(F.col("is_low_sample"), F.lit(False))
    return cells.withColumn("visible_value", F.when(~hidden, F.col("value")))


def value_bounds(masked: DataFrame) -> DataFrame:
    """One row with the smallest and largest visible value, NULLs when there is none."""
    shown = F.nanvl("visible_value", F.lit(None).cast("double"))
    return masked.agg(F.min(shown).alias("value_min"), F.max(shown).alias("value_max"))


def cell_details(
    cells: DataFrame, *, low: str = LOW_SAMPLE_LABEL, enough: str = ENOUGH_LABEL
) -> DataFrame:
    """One detail record per cell: counts, reliability label and unmasked value."""
    flagged = F.coalesce(F.col("is_low_sample"), F.lit(False))
    return cells.select(
        *CELL_KEYS,
        F.struct(
            "value_count",
            "sample_count",
            F.when(flagged, F.lit(low)).otherwise(F.lit(enough)).alias("reliability"),
            "value",
        ).alias("detail"),
    )


def normalise_range(selected, bounds: tuple[float, float]) -> tuple[float, float]:
    """A selected value range inside the bounds; unusable input gives the bounds.

    A mapping with ``minimum`` and ``maximum`` is a range too; an end it lacks is the bound.
    """
    low, high = ordered_range(*map(float, bounds))
    if isinstance(selected, Mapping):
        ends = (selected.get(name) for name in ("minimum", "maximum"))
        selected = [bound if end is None else end for end, bound in zip(ends, (low, high))]
    ends = _selected_ends(selected)
    if ends is None:
        return low, high
    return ordered_range(*[min(max(end, low), high) for end in ends])


def _selected_ends(selected) -> tuple[float, float] | None:
    if not isinstance(selected, (tuple, list)) or len(selected) < 2:
        return None
    try:
        ends = float(selected[0]), float(selected[1])
    except (TypeError, ValueError):
        return None
    return None if any(map(math.isnan, ends)) else ends


def clamp_values(
    masked: DataFrame,
    selected: tuple[float, float] | None = None,
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Adds ``color_value``, saturated at the selected range, and its 0..1 position.

    Without ``bounds`` they are a subquery over the visible values. An empty or
    single-valued range leaves values as they are and gives no position.
    """
    if bounds is None:
        found = value_bounds(masked)
        low_bound, high_bound = (found.select(c).scalar() for c in found.columns)
    else:
        low_bound, high_bound = map(F.lit, ordered_range(*map(float, bounds)))
    low, high = _selected_range(selected, low_bound, high_bound)
    # least/greatest skip NULLs, so hidden cells have to be kept out first.
    value = F.col("visible_value")
    saturated = F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
    return masked.withColumn(
        "color_value", F.when(low < high, saturated).otherwise(value)
    ).withColumn("color_position", F.when(low < high, (F.col("color_value") - low) / (high - low)))


def _selected_range(selected, low: Column, high: Column) -> tuple[Column, Column]:
    ends = _selected_ends(selected)
    if ends is None:
        return low, high
    first, second = (F.least(F.greatest(F.lit(end), low), high) for end in ends)
    return F.least(first, second), F.greatest(first, second)
