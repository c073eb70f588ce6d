"""Gold: the fact table and the summaries made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.functions import rules

# Fixed values
FACT_COLUMNS = (
    "flight_date",
    "origin",
    "dest",
    "airline",
    "distance",
    "dep_delay",
    "arr_delay",
    "cancelled_flag",
    "distance_bucket",
    "delay_bucket",
)


def standard_codes(silver: DataFrame) -> DataFrame:
    return silver.withColumns(
        {
            "origin": rules.airport_code(F.col("origin")),
            "dest": rules.airport_code(F.col("dest")),
            "airline": rules.airline_name(F.col("airline")),
        }
    )


def to_fact(silver: DataFrame) -> DataFrame:
    """The 10-column fact table; rows without a date are left out."""
    dated = silver.filter(F.col("flight_date").isNotNull())
    return standard_codes(dated).select(*FACT_COLUMNS)


def preview(fact: DataFrame, rows: int = 5) -> DataFrame:
    """First rows in the order of all columns, so that the choice never varies."""
    return fact.orderBy(*[F.col(c).asc_nulls_last() for c in fact.columns]).limit(rows)


def _summary(fact: DataFrame, *keys: str) -> DataFrame:
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum("cancelled_flag").alias("cancelled"),
        F.count_if(F.col("delay_bucket") == "DELAYED").alias("delayed"),
        F.round(F.avg("dep_delay"), 6).alias("avg_dep_delay"),
        F.round(F.avg("arr_delay"), 6).alias("avg_arr_delay"),
    )


def partial_summary(fact: DataFrame, *keys: str) -> DataFrame:
    """What ``merge_summaries`` makes the summary by the keys from: counts, and sums that are exact
    as long as the delays are whole numbers."""
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum("cancelled_flag").alias("cancelled"),
        F.count_if(F.col("delay_bucket") == "DELAYED").alias("delayed"),
        *[F.sum(c).alias(f"{c}_sum") for c in ("dep_delay", "arr_delay")],
        *[F.count(c).alias(f"{c}_n") for c in ("dep_delay", "arr_delay")],
    )


def merge_summaries(states: DataFrame, *keys: str) -> DataFrame:
    """The summary by the keys, of all fact rows that the states were made from."""
    merged = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in states.columns if c not in keys]
    )
    averages = [
        F.round(F.col(f"{c}_sum") / F.nullif(F.col(f"{c}_n"), F.lit(0)), 6).alias(f"avg_{c}")
        for c in ("dep_delay", "arr_delay")
    ]
    return merged.select(*keys, "flights", "cancelled", "delayed", *averages)


def mart_airline(fact: DataFrame) -> DataFrame:
    return _summary(fact, "airline")


def mart_route(fact: DataFrame) -> DataFrame:
    return _summary(fact, "origin", "dest")


def mart_calendar(fact: DataFrame) -> DataFrame:
    calendar = fact.withColumns(
        {
            "year": F.year("flight_date"),
            "month": F.month("flight_date"),
            "day_of_week": F.dayofweek("flight_date"),
        }
    )
    return _summary(calendar, "year", "month", "day_of_week")


def bucket_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("distance_bucket", "delay_bucket").agg(
        F.count(F.lit(1)).alias("flights"),
        F.sum("cancelled_flag").alias("cancelled"),
    )
