"""Silver: typed, bucketed records. Works on batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import FILE_ROWS
from delaylake.functions import rules

# Fixed values
SILVER_COLUMNS = (
    "flight_date",
    "year",
    "month",
    "day_of_week",
    "airline",
    "origin",
    "dest",
    "distance",
    "dep_delay",
    "arr_delay",
    "cancelled_flag",
    "cancellation_reason",
    "distance_bucket",
    "delay_bucket",
    "ingest_ts",
)
SILVER_SCHEMA = (
    "flight_date date, year int, month int, day_of_week int, airline string, origin string, "
    "dest string, distance double, dep_delay double, arr_delay double, cancelled_flag int, "
    "cancellation_reason string, distance_bucket string, delay_bucket string, ingest_ts timestamp"
)
FILL_DEFAULTS = {"cancelled_flag": 0}


def canonical_columns(parsed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Lower-case names and proper types; the flag is still text."""
    return parsed.select(
        rules.as_date(F.col("FL_DATE")).alias("flight_date"),
        F.col("AIRLINE").alias("airline"),
        F.col("ORIGIN").alias("origin"),
        F.col("DEST").alias("dest"),
        rules.as_number(F.col("DISTANCE")).alias("distance"),
        rules.as_number(F.col("DEP_DELAY")).alias("dep_delay"),
        rules.as_number(F.col("ARR_DELAY")).alias("arr_delay"),
        F.col("CANCELLED").alias("cancelled"),
        F.col("CANCELLATION_REASON").alias("cancellation_reason"),
        *keep,
    )


def date_parts(typed: DataFrame) -> DataFrame:
    """Year, month and weekday (1 = Sunday) of ``flight_date``."""
    return typed.withColumns(
        {
            "year": F.year("flight_date"),
            "month": F.month("flight_date"),
            "day_of_week": F.dayofweek("flight_date"),
        }
    )


def to_silver(
    parsed: DataFrame, ingest_ts: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The 15-column table, one row per message, and after them the columns named in ``keep``."""
    typed = date_parts(canonical_columns(parsed, keep))
    ruled = typed.withColumns(
        {
            "cancelled_flag": rules.cancelled_flag(F.col("cancelled")),
            "distance_bucket": rules.distance_bucket(F.col("distance")),
            "delay_bucket": rules.delay_bucket(F.col("dep_delay")),
            "ingest_ts": F.current_timestamp() if ingest_ts is None else ingest_ts,
        }
    )
    return ruled.select(*SILVER_COLUMNS, *keep).fillna(FILL_DEFAULTS)


def write_silver(silver: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Overwrite the table and return it as stored (its row count is in the footers).

    Unpartitioned, the job has no shuffle. With ``partition_by`` the rows are
    rebalanced first, so that a month is neither scattered over every task's own
    small file nor, when it is a large share of the data, left to one task.
    """
    rows = silver.hint("rebalance", *partition_by) if partition_by else silver
    files = rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    files.partitionBy(*partition_by).parquet(path)
    return read_silver(silver.sparkSession, path)


def read_silver(spark: SparkSession, path: str, part: str = "true") -> DataFrame:
    """The stored table with its columns in their order, also where some name folders; ``part`` is
    a condition, which may be on columns that only name folders."""
    return spark.read.schema(SILVER_SCHEMA).parquet(path).where(part).select(*SILVER_COLUMNS)
