"""Running totals over an ordered table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.workspace import range_parts


def running_before(
    df: DataFrame, order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Add the total of ``value`` over all rows that come before a row in the order.

    The rows are range-partitioned by the order, which should tell them apart. The total
    is that of the partitions before, plus the running total within the partition.
    """
    parts = range_parts(df.withColumn("_value", value), *order)
    # One row per range partition, so at most spark.sql.shuffle.partitions rows.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("_part")
        .agg(F.sum("_value").alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_part").orderBy(*order)
    inside = F.sum("_value").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return (
        parts.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_value", "_offset", "_inside")
    )
