"""Null-on-failure conversions from loosely typed columns to contract types.

Each function takes a column together with the Spark type it currently has and
returns a column of the target type that is NULL where the value is not legal.
A column that already has the target type is passed through untouched, so that
predicates on typed tables still reach the parquet scan.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character Python's str.strip() removes, listed by rule.
WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

# Plain decimal notation only: Spark's own cast would also take '1d' and '0x1p3'.
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# The words for true and false.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")


def _padded(text: Column) -> Column:
    return F.left(text, F.lit(1)).isin(*WHITESPACE) | F.right(text, F.lit(1)).isin(*WHITESPACE)


def strip_text(column: Column) -> Column:
    """Text without leading and trailing whitespace.

    Trimming a set of characters is slow, so it is kept to text that needs it.
    """
    text = column.cast("string")
    return F.when(_padded(text), F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def non_empty_text(column: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip_text(column), F.lit(""))


def whole_number(column: Column, source: T.DataType) -> Column:
    """Integer value; decimal text loses its fraction, other text becomes NULL."""
    if isinstance(source, T.IntegerType):
        return column
    if isinstance(source, (T.NumericType, T.BooleanType)):
        return column.try_cast("int")
    # The pattern goes first: a try_cast that fails costs far more than one that works.
    return F.when(column.rlike(DECIMAL_TEXT), column.try_cast("double").try_cast("int"))


def truth_value(column: Column, source: T.DataType) -> Column:
    """Boolean value; numbers other than 0 and 1 become NULL."""
    if isinstance(source, T.BooleanType):
        return column
    if isinstance(source, T.NumericType):
        return F.when(column == 1, F.lit(True)).when(column == 0, F.lit(False))
    word = F.lower(strip_text(column))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def _timestamp_text(column: Column) -> Column:
    """Timestamp of text. Good text takes one cast; only padded text that failed is stripped and cast again."""
    stripped = F.when(_padded(column), F.btrim(column, F.lit(WHITESPACE)).try_cast("timestamp"))
    return F.coalesce(column.try_cast("timestamp"), stripped)


def instant(column: Column, source: T.DataType) -> Column:
    """Timestamp value."""
    if isinstance(source, T.TimestampType):
        return column
    if isinstance(source, T.StringType):
        return _timestamp_text(column)
    return column.try_cast("timestamp")


def day(column: Column, source: T.DataType) -> Column:
    """Date value; a time of day is dropped."""
    if isinstance(source, T.DateType):
        return column
    if isinstance(source, T.StringType):
        # Through timestamp, because text-to-date ignores whatever follows the day.
        return _timestamp_text(column).try_cast("date")
    return column.try_cast("date")
