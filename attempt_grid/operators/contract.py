"""The 17-column attempt contract: projection, coercion and violation report."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attempt_grid.functions import casts

# Names, order and types of the attempt table.
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("client_time", T.TimestampType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("balance_id", T.IntegerType()),
        T.StructField("traffic_type", T.StringType()),
        T.StructField("payer_type", T.StringType()),
        T.StructField("failed", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("platform_name", T.StringType()),
        T.StructField("first_attempt", T.IntegerType()),
        T.StructField("FW", T.IntegerType()),
        T.StructField("CW", T.IntegerType()),
        T.StructField("CF", T.IntegerType()),
        T.StructField("FF", T.IntegerType()),
        T.StructField("reason_seg", T.StringType()),
        T.StructField("partition_date", T.DateType()),
        T.StructField("level_cohort", T.IntegerType()),
        T.StructField("super_ball", T.BooleanType()),
    ]
)
ATTEMPT_COLUMNS = tuple(ATTEMPT_SCHEMA.names)
CANONICAL_ORDER = ("partition_date", "level_cohort", "user_id", "balance_id")

_COMPLAINTS = {
    T.StringType: "is empty",
    T.IntegerType: "is not a number",
    T.BooleanType: "is not a boolean",
    T.TimestampType: "is not a timestamp",
    T.DateType: "is not a date",
}


class ContractError(ValueError):
    """The input cannot be read as attempt rows."""


def require_columns(df: DataFrame) -> None:
    """Raise when one of the 17 columns is missing; extra columns are fine."""
    missing = sorted(set(ATTEMPT_COLUMNS) - set(df.columns))
    if missing:
        raise ContractError(f"attempt rows need the columns {', '.join(missing)}")


def _coerced(df: DataFrame, field: T.StructField, trim_text: bool) -> Column:
    column, source = F.col(field.name), df.schema[field.name].dataType
    match field.dataType:
        case T.StringType():
            if trim_text:
                return casts.non_empty_text(column)
            return column if isinstance(source, T.StringType) else column.cast("string")
        case T.IntegerType():
            return casts.whole_number(column, source)
        case T.BooleanType():
            return casts.truth_value(column, source)
        case T.TimestampType():
            return casts.instant(column, source)
        case _:
            return casts.day(column, source)


def to_contract(df: DataFrame, *, trim_text: bool = True, strict: bool = False) -> DataFrame:
    """Exactly the 17 columns, in order and typed; illegal values become NULL.

    ``trim_text=False`` leaves text columns alone. Use it for tables that were
    written from contract rows: a bare column reference keeps payer, traffic and
    platform predicates in the parquet scan, a trimmed one does not.

    ``strict=True`` starts one job that looks for the first violation and raises.
    """
    require_columns(df)
    if strict:
        first = contract_rejects(df).select("reject_reasons").head(1)
        if first:
            raise ContractError("; ".join(first[0][0]))
    return df.select(
        *[_coerced(df, field, trim_text).alias(field.name) for field in ATTEMPT_SCHEMA]
    )


def contract_rejects(df: DataFrame) -> DataFrame:
    """Rows that violate the contract, as they came in, with all their reasons."""
    require_columns(df)
    legal = {field.name: _coerced(df, field, True).isNotNull() for field in ATTEMPT_SCHEMA}
    reasons = [
        F.when(~legal[field.name], F.lit(f"{field.name} {_COMPLAINTS[type(field.dataType)]}"))
        for field in ATTEMPT_SCHEMA
    ]
    broken = ~reduce(operator.and_, legal.values())
    # A generator, not a filter, selects the rows: a filter would be pushed down
    # and repeat the computation of derived input columns for every use of them.
    reported = F.when(broken, F.array(F.array_compact(F.array(*reasons))))
    return df.select(*ATTEMPT_COLUMNS, F.explode(reported).alias("reject_reasons"))


ACCEPTED, REJECTED = "accepted", "rejected"


@dataclass(frozen=True, slots=True)
class ContractCounts:
    """How many rows were accepted and rejected, and how many broke each rule (one row may break several)."""

    accepted: int
    rejected: int
    reasons: Mapping[str, int]


def write_checked(df: DataFrame, path: str, *, strict: bool = False) -> ContractCounts:
    """Write accepted rows typed and rejected rows as they came in, side by side, in one pass.

    The input is read once; the counts are taken on the way. ``read_accepted`` and
    ``read_rejected`` each open their own part of the files. ``strict`` raises at the end if
    anything was rejected; what was written stays for inspection.
    """
    require_columns(df)
    complaints = {f.name: f"{f.name} {_COMPLAINTS[type(f.dataType)]}" for f in ATTEMPT_SCHEMA}
    typed = df.select(
        *[_coerced(df, field, True).alias(field.name) for field in ATTEMPT_SCHEMA],
        F.struct(*ATTEMPT_COLUMNS).alias("raw"),
    )
    broken = reduce(operator.or_, [F.col(name).isNull() for name in ATTEMPT_COLUMNS])
    reasons = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(text)) for n, text in complaints.items()]))
    counts = Observation()
    rows = typed.observe(
        counts,
        F.count_if(~broken).alias(ACCEPTED),
        F.count_if(broken).alias(REJECTED),
        *[F.count_if(F.col(name).isNull()).alias(f"of_{name}") for name in ATTEMPT_COLUMNS],
    )
    (
        rows.select(
            *ATTEMPT_COLUMNS,
            F.when(broken, F.col("raw")).alias("raw"),
            F.when(broken, reasons).alias("reject_reasons"),
            F.when(broken, F.lit(REJECTED)).otherwise(F.lit(ACCEPTED)).alias("verdict"),
        )
        .write.mode("overwrite")
        .partitionBy("verdict")
        .parquet(path)
    )
    found = counts.get
    result = ContractCounts(
        found[ACCEPTED], found[REJECTED], {text: n for name, text in complaints.items() if (n := found[f"of_{name}"])}
    )
    if strict and result.rejected:
        raise ContractError(f"{result.rejected} rows rejected: " + ", ".join(f"{t} ({n})" for t, n in result.reasons.items()))
    return result


def _checked(spark: SparkSession, path: str, verdict: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("verdict") == verdict)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The contract rows that ``write_checked`` accepted; bare columns, so filters reach the files."""
    return _checked(spark, path, ACCEPTED).select(*ATTEMPT_COLUMNS)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_checked`` rejected, as they came in, with all their reasons."""
    return _checked(spark, path, REJECTED).select("raw.*", "reject_reasons")


def canonical_sort(attempts: DataFrame) -> DataFrame:
    """Attempt rows in their canonical order: a global range sort, for exports only.

    Client time breaks ties, so that a player's countless attempts at one level on
    one day are not a single key that only one task can sort.
    """
    return attempts.orderBy(*CANONICAL_ORDER, "client_time")
