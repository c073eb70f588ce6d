from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from delaylake.operators import slicing


def by_hand(total, slices=10):
    size, numbers, number, filled = total // slices, [], 1, 0
    for _ in range(total):
        numbers.append(number)
        filled += 1
        if filled >= size and number < slices:
            number, filled = number + 1, 0
    return numbers


@given(st.integers(0, 400), st.integers(1, 15))
def test_starts_match_a_counter(total, slices):
    starts = slicing.slice_starts(total, slices)
    numbers = [1 + sum(i >= s for s in starts) for i in range(total)]
    assert numbers == by_hand(total, slices)


def sliced_by_key(df, keys, slices=10):
    return slicing.assign_slices(df, slicing.cuts_by_key(df, keys, slices))


@pytest.mark.parametrize("total", [0, 1, 7, 10, 103, 1000])
def test_by_key(spark, total):
    df = spark.range(total).select((F.col("id") * 7 % max(total, 1)).alias("k")) if total % 7 else (
        spark.range(total).withColumnRenamed("id", "k")
    )
    rows = sorted((r.k, r.slice) for r in sliced_by_key(df.repartition(5), ["k"]).collect())
    assert [s for _, s in rows] == by_hand(total)


def test_103_rows(spark):
    df = spark.range(103)
    sizes = Counter(r.slice for r in sliced_by_key(df, ["id"]).collect())
    assert sizes == {**{s: 10 for s in range(1, 10)}, 10: 13}


def test_key_of_two_columns_with_nulls_and_a_hot_value(spark):
    # A third of all rows share the first key column; some rows have none.
    df = spark.range(900).select(
        F.when(F.col("id") < 300, F.lit("hot"))
        .when(F.col("id") % 10 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("a"),
        F.col("id").alias("b"),
    )
    rows = sliced_by_key(df, ["a", "b"]).collect()
    ordered = sorted(rows, key=lambda r: (r.a is not None, r.a or "", r.b))
    assert [r.slice for r in ordered] == by_hand(900)


def test_hot_key_is_spread_over_the_range_partitions(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).alias("a")
    )
    spread = (
        hot.select("a", F.monotonically_increasing_id().alias("s"))
        .repartitionByRange(8, "a", "s")
        .groupBy(F.spark_partition_id())
        .count()
    )
    assert max(r["count"] for r in spread.collect()) < 30000 / 4


def test_equal_keys_across_a_cut_are_refused(spark):
    df = spark.range(100).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="two slices"):
        slicing.cuts_by_key(df, ["k"], 10)


def test_equal_keys_within_a_slice_are_fine(spark):
    df = spark.range(100).select((F.col("id") - F.col("id") % 5).alias("k"))
    sizes = Counter(r.slice for r in sliced_by_key(df, ["k"]).collect())
    assert set(sizes.values()) == {10} and len(sizes) == 10


@pytest.mark.parametrize("total", [3, 103, 1000])
def test_by_file_position(spark, tmp_path, total):
    path = str(tmp_path / "t")
    spark.range(total).repartition(4).write.parquet(path)
    rows = slicing.with_file_position(spark.read.parquet(path))
    cuts = slicing.cuts_by_position(rows, 10)
    found = slicing.assign_slices(rows, cuts).collect()
    ordered = sorted(found, key=lambda r: (r.src_file, r.src_row))
    assert [r.slice for r in ordered] == by_hand(total)


def test_position_with_several_splits_per_file(spark):
    # Row numbers need not start at 0 in a split, nor grow along the file.
    places = [("f1", 0, 50, 13), ("f1", 900, 7, 40), ("f2", 0, 1000, 50)]
    rows = [(f, b, first + i) for f, b, first, n in places for i in range(n)]
    df = spark.createDataFrame(rows, "src_file string, src_block bigint, src_row bigint")
    found = slicing.assign_slices(df, slicing.cuts_by_position(df, 10)).collect()
    ordered = sorted(found, key=lambda r: (r.src_file, r.src_block, r.src_row))
    assert [r.slice for r in ordered] == by_hand(103)


def test_empty_source(spark, tmp_path):
    df = spark.createDataFrame([], "src_file string, src_block bigint, src_row bigint")
    assert slicing.cuts_by_position(df, 10).starts == ()


def test_progress(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "slice int")
    found = [tuple(r) for r in slicing.slice_progress(df).orderBy("slice").collect()]
    assert found == [(1, 2, 2), (2, 1, 3), (3, 1, 4)]
