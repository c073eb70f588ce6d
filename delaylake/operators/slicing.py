"""Cutting a bounded source into consecutive slices, to be replayed one by one.

With ``n`` slices and ``total`` rows every slice has ``max(total // n, 1)`` rows and
the last one takes the remainder. A slice is an interval of the row order, so at most
``n - 1`` cut rows describe all of them. Finding the cuts touches the order columns
only; putting the slice number on the full rows is then a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylake.operators.ordering import running_before
from delaylake.sources.csv_records import POSITION
from delaylake.workspace import range_parts, written


@dataclass(frozen=True)
class Cuts:
    """First row of the second slice, of the third, and so on, by its order values."""

    order: T.StructType
    starts: tuple[tuple, ...]


def slice_starts(total: int, slices: int) -> list[int]:
    """0-based index of the first row of slices 2, 3, ..."""
    size = max(total // slices, 1)
    return [k * size for k in range(1, slices) if k * size < total]


def _order_type(df: DataFrame, order_by: Sequence[str]) -> T.StructType:
    return T.StructType([df.schema[c] for c in order_by])


def cuts_by_key(df: DataFrame, order_by: Sequence[str], slices: int) -> Cuts:
    """Cuts in the order of key columns that tell rows apart.

    One scan and one range shuffle of the key columns. The row counter as last range
    column lets Spark spread a key that many rows share over many partitions.
    """
    order = [*order_by, "_seq"]
    keys = range_parts(
        df.select(*order_by, F.monotonically_increasing_id().alias("_seq")), *order
    )
    # One row per range partition, so at most spark.sql.shuffle.partitions rows.
    sizes = sorted((r["_part"], r["count"]) for r in keys.groupBy("_part").count().collect())
    total = sum(n for _, n in sizes)

    # The cut rows and the rows just before them, as (partition, number in it).
    wanted: dict[tuple[int, int], int] = {}
    starts = slice_starts(total, slices)
    for rank in {r for s in starts for r in (s - 1, s)}:
        begin = 0
        for part, n in sizes:
            if begin <= rank < begin + n:
                wanted[part, rank - begin + 1] = rank
                break
            begin += n
    numbered = keys.filter(F.col("_part").isin(sorted({p for p, _ in wanted}))).withColumn(
        "_number", F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    )
    places = [F.struct(F.lit(p), F.lit(i)) for p, i in wanted]
    found = numbered.filter(F.struct("_part", "_number").isin(*places)) if places else None
    at = {
        wanted[row["_part"], row["_number"]]: tuple(row[c] for c in order_by)
        for row in (found.collect() if found is not None else [])
    }
    if any(at[s - 1] == at[s] for s in starts):
        raise ValueError(f"rows with equal {list(order_by)} fall into two slices: add a column")
    return Cuts(_order_type(df, order_by), tuple(at[s] for s in starts))


def cuts_by_position(df: DataFrame, slices: int, position: Sequence[str] = POSITION) -> Cuts:
    """Cuts in the order of the source files, without sorting any rows.

    The position is (file, split, row number), the last one without gaps in a split.
    Rows are counted per split, and the cut lies a known number of rows into one.
    """
    *place, row = position
    splits = df.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    placed = written(running_before(splits, place, F.col("n"), "begin"), "splits")
    total = placed.agg(F.sum("n")).first()[0] or 0
    starts = slice_starts(total, slices)
    if not starts:
        return Cuts(_order_type(df, position), ())
    here = F.explode(
        F.filter(
            F.array(*[F.lit(s).cast("bigint") for s in starts]),
            lambda s: (s >= F.col("begin")) & (s < F.col("begin") + F.col("n")),
        )
    )
    cuts = placed.withColumn("cut", here).select(
        "cut", *place, (F.col("first") + F.col("cut") - F.col("begin")).alias(row)
    )
    found = {r["cut"]: tuple(r[c] for c in position) for r in cuts.collect()}
    return Cuts(_order_type(df, position), tuple(found[s] for s in starts))


def with_file_position(df: DataFrame) -> DataFrame:
    """Position columns for a frame read from Parquet files, which know their row numbers."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.lit(0).cast("bigint").alias("src_block"),
        F.col("_metadata.row_index").alias("src_row"),
    )


def _at_or_after(order: T.StructType, start: tuple) -> Column:
    here = F.struct(*order.names)
    there = F.struct(
        *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(start, order.fields)]
    )
    return F.when(here >= there, 1).otherwise(0)


def assign_slices(df: DataFrame, cuts: Cuts) -> DataFrame:
    """Add the 1-based ``slice`` of every row."""
    number = F.lit(1)
    for start in cuts.starts:
        number = number + _at_or_after(cuts.order, start)
    return df.withColumn("slice", number)


def slice_progress(sliced: DataFrame) -> DataFrame:
    """Rows per slice and the running total; the window sees one row per slice."""
    up_to_here = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    counts = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("running_total", F.sum("n").over(up_to_here))
