"""Flight-shaped records mapped from ``lineitem``, and messages from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flight_records(lineitem: DataFrame, *also: str) -> DataFrame:
    """Nine text fields with missing, empty, malformed and over-long values in them,
    after the columns named in ``also``."""
    returned = F.col("l_returnflag") == "R"
    number = F.col("l_linenumber")
    supplier = F.col("l_suppkey")

    def padded(value, width):
        return F.lpad(value.cast("string"), width, "0")

    return lineitem.select(
        *also,
        F.when(F.col("l_orderkey") % 97 == 0, "bad")
        .when(F.col("l_orderkey") % 89 == 0, None)
        .otherwise(F.col("l_shipdate").cast("date").cast("string"))
        .alias("FL_DATE"),
        F.when(supplier % 13 == 0, None)
        .otherwise(F.concat(F.lit("CARRIER-"), padded(supplier, 4)))
        .alias("AIRLINE"),
        F.when(number == 7, None)
        .otherwise(F.concat(F.lit("O"), padded(supplier % 40, 3)))
        .alias("ORIGIN"),
        F.concat(F.lit("D"), (F.col("l_partkey") % 30).cast("string")).alias("DEST"),
        F.when(number == 6, "")
        .otherwise((F.col("l_quantity") * 40).cast("string"))
        .alias("DISTANCE"),
        F.when(returned, "")
        .otherwise((F.col("l_quantity") - 20).cast("string"))
        .alias("DEP_DELAY"),
        F.when(returned, "")
        .otherwise((F.col("l_quantity") - 22).cast("string"))
        .alias("ARR_DELAY"),
        F.when(returned, "1.0").when(number == 5, "").otherwise("0.0").alias("CANCELLED"),
        F.when(returned, F.col("l_linestatus")).otherwise("").alias("CANCELLATION_REASON"),
    )
