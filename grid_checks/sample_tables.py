"""The star-schema sample tables seen as attempts, raw level events and players."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attempt_grid.functions.attempts import indicator
from attempt_grid.operators.contract import ATTEMPT_COLUMNS

# Every day a line item's attempt can be dated to: the first of each month of seven years.
MONTHS = tuple(date(year, month, 1) for year in range(1995, 2002) for month in range(1, 13))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One sample table. Its timestamps carry no zone and are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the number ``k`` of their JSON properties."""
    # A generator parses once per row; filters on k would copy a plain expression.
    parsed = table(spark, sf_dir, "events").select(
        "user_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.json_tuple("props", "k").alias("k"),
    )
    return parsed.withColumn("k", F.col("k").cast("int"))


def _payer(balance: str) -> Column:
    return F.when(F.col(balance) > 5000, "payer").otherwise("nonpayer")


def attempts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 level buckets x 30 days; customers give traffic and payer type."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("traffic_type"),
        _payer("c_acctbal").alias("payer_type"),
    )
    kind, k = F.col("event_type"), F.col("k")
    attempt = 1 + k % 3
    return (
        events(spark, sf_dir)
        .join(customers, "user_id")
        .select(
            F.col("ts").alias("client_time"),
            F.col("user_id").cast("string").alias("user_id"),
            k.alias("balance_id"),
            "traffic_type",
            "payer_type",
            indicator(kind.isin("view", "error")).alias("failed"),
            attempt.alias("attempt"),
            F.when(k % 2 == 0, "ios").otherwise("android").alias("platform_name"),
            indicator(attempt == 1).alias("first_attempt"),
            *_outcomes(kind),
            _segment(kind).alias("reason_seg"),
            F.to_date("ts").alias("partition_date"),
            F.floor(k / F.lit(10.0)).cast("int").alias("level_cohort"),
            (F.col("value") > 50).alias("super_ball"),
        )
        .select(*ATTEMPT_COLUMNS)
    )


def attempts_with_stray_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts from events, where days 6 and 7 have lost their date and two others lie far off."""
    day = F.dayofmonth("partition_date")
    moved = (
        F.when(day == 5, F.lit(date(1900, 1, 1)))
        .when(day == 20, F.lit(date(2200, 12, 31)))
        .when(~day.isin(6, 7), F.col("partition_date"))
    )
    return attempts_from_events(spark, sf_dir).withColumn("partition_date", moved)


# Which event type plays which outcome; sign-ups have none.
_EVENT_FLAGS = {"FW": "click", "CW": "purchase", "CF": "view", "FF": "error"}
_EVENT_SEGMENTS = {
    "click": "far_win",
    "purchase": "close_win",
    "view": "close_fail",
    "error": "far_fail",
}


def _outcomes(kind: Column) -> list[Column]:
    return [indicator(kind == event).alias(flag) for flag, event in _EVENT_FLAGS.items()]


def _segment(kind: Column) -> Column:
    found = [F.when(kind == event, F.lit(name)) for event, name in _EVENT_SEGMENTS.items()]
    return F.coalesce(*found, F.lit("unknown"))


def attempts_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of part buckets x 83 months; the large input for statistics."""
    orders = (
        table(spark, sf_dir, "orders")
        .join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("o_orderpriority").alias("traffic_type"),
            F.col("o_orderstatus").alias("platform_name"),
            _payer("c_acctbal").alias("payer_type"),
        )
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    outcome = {
        "FW": (flag == "A") & (status == "F"),
        "CW": (flag == "A") & (status == "O"),
        "CF": (flag == "R") & (status == "O"),
        "FF": (flag == "R") & (status == "F"),
    }
    segment = (
        F.when(outcome["FW"], "far_win")
        .when(outcome["CW"], "close_win")
        .when(outcome["CF"], "close_fail")
        .when(outcome["FF"], "far_fail")
        .otherwise("unknown")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, "l_orderkey")
        .select(
            F.col("l_shipdate").cast("timestamp").alias("client_time"),
            "user_id",
            F.col("l_partkey").cast("int").alias("balance_id"),
            "traffic_type",
            "payer_type",
            indicator(flag == "R").alias("failed"),
            F.col("l_linenumber").cast("int").alias("attempt"),
            "platform_name",
            indicator(F.col("l_linenumber") == 1).alias("first_attempt"),
            *[indicator(condition).alias(name) for name, condition in outcome.items()],
            segment.alias("reason_seg"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("partition_date"),
            F.floor(F.col("l_partkey") / F.lit(100.0)).cast("int").alias("level_cohort"),
            (F.col("l_discount") > 0.05).alias("super_ball"),
        )
        .select(*ATTEMPT_COLUMNS)
    )


def levels_from_events(spark: SparkSession, sf_dir: str, *, chained: bool) -> DataFrame:
    """Raw level events with JSON payloads.

    ``chained`` decides whether the usual event has the chain ``main`` or none.
    """
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    usual, other = ("main", None) if chained else (None, "main")
    chain = (
        F.when(value > 150, "WL_1")
        .when(value > 120, "WLX1")
        .when(value > 100, F.lit(other))
        .otherwise(F.lit(usual))
    )
    spelled = F.when(k == 50, "abc").when(k == 52, "1.0").when(k == 53, "1e0").when(k == 54, "2.9")
    attempt = F.coalesce(spelled, F.when(k != 51, (1 + k % 3).cast("string")))
    level_id = F.when(k == 13, "x").when(
        k != 14, F.concat(F.lit("st"), F.lpad((k * 10).cast("string"), 5, "0"))
    )
    segment = F.when(~((kind == "error") & (value < 50)), _segment(kind))
    platform = F.when(k % 2 == 0, "ios").otherwise("android")
    ab_group = (
        F.when(
            kind == "click",
            F.concat(F.lit('["grp_'), (k % 7).cast("string"), F.lit('","base"]')),
        )
        .when(
            kind == "view",
            F.concat(F.lit('{"obj_'), (k % 5).cast("string"), F.lit('":1,"base":2}')),
        )
        .when(kind == "purchase", "")
        .when(kind == "error", "broken")
    )
    return events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("client_time"),
        F.when(value >= 1, F.col("ts") - F.make_dt_interval(hours=k)).alias("event_time"),
        F.to_date("ts").alias("partition_date"),
        F.when(k >= 95, "m3.level_started").otherwise("m3.level_finished").alias("event_type"),
        F.when(kind.isin("click", "purchase"), "completed")
        .when(kind == "signup", "aborted")
        .otherwise("failed")
        .alias("reason"),
        chain.alias("chain"),
        F.when(value > 60, "payer").otherwise("nonpayer").alias("payer_type"),
        ab_group.alias("ab_group"),
        attempt.alias("attempt"),
        F.to_json(
            F.struct(
                level_id.alias("balance_id"),
                segment.alias("reason_seg"),
                attempt.alias("attempt"),
                (value > 50).alias("super_ball"),
            )
        ).alias("event_payload"),
        F.when(
            k == 7, F.to_json(F.struct(F.struct(platform.alias("platform_name")).alias("tech")))
        )
        .otherwise(F.to_json(F.struct(platform.alias("tech.platform_name"))))
        .alias("user_payload"),
    )


def players_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player state; customers in debt have a second traffic type, all rows come twice."""
    balance = F.col("c_acctbal")
    second = F.when(balance < 0, "crosspromo").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.explode(F.array("c_mktsegment", second)).alias("traffic_type"),
        F.when(balance > 8000, "Cheater")
        .when(balance > 4000, "Soft")
        .otherwise("Fair")
        .alias("cheater"),
    )


def outcomes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome flags of all but some error events; NULL where not set, some rows twice."""
    kind, k = F.col("event_type"), F.col("k")
    copies = F.when(F.col("value") > 90, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        events(spark, sf_dir)
        .filter((kind != "error") | (k < 50))
        .select(
            F.col("ts").alias("client_time"),
            F.when(~k.isin(13, 14), k * 10).alias("balance_id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.to_date("ts").alias("partition_date"),
            *[F.when(kind == event, 1).alias(flag) for flag, event in _EVENT_FLAGS.items()],
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def text_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts as untidy text with a surplus column; a good part breaks the contract."""
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events(spark, sf_dir).select(
        F.lit("ignored").alias("surplus"),
        F.when(value > 200, "not a time").otherwise(stamp).alias("client_time"),
        F.when(k == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("user_id"), F.lit("\t"))).alias(
            "user_id"
        ),
        F.concat(k.cast("string"), F.lit(".9")).alias("balance_id"),
        F.when(kind == "signup", "NULL").otherwise(" organic ").alias("traffic_type"),
        F.when(k == 4, "").when(value > 60, "payer").otherwise("nonpayer").alias("payer_type"),
        F.when(kind.isin("view", "error"), " 1 ").otherwise("0").alias("failed"),
        F.when(k == 50, "abc").when(k == 52, "1d").otherwise(
            F.concat((1 + k % 3).cast("string"), F.lit("e0"))
        ).alias("attempt"),
        F.when(k % 2 == 0, "ios").otherwise("android").alias("platform_name"),
        indicator(k % 3 == 0).alias("first_attempt"),
        *[c.cast("double").alias(name) for name, c in zip(_EVENT_FLAGS, _outcomes(kind))],
        _segment(kind).alias("reason_seg"),
        F.when(k == 5, "2024-13-01").otherwise(stamp).alias("partition_date"),
        F.when(k != 6, F.floor(k / F.lit(10.0))).alias("level_cohort"),
        F.when(value > 50, " Yes ").when(k == 60, "on").when(k == 61, "2").otherwise("F").alias(
            "super_ball"
        ),
    )
