"""Feature stages, on Spark MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StandardScalerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.operators.ordering import running_before
from delaylake.operators.training_data import CATEGORICAL, NUMERIC
from delaylake.workspace import written


def _index(names: Sequence[str]) -> list[str]:
    return [f"{name}_idx" for name in names]


def _one_hot(names: Sequence[str]) -> list[str]:
    return [f"{name}_ohe" for name in names]


def category_counts(df: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows (column, value, n) of all columns, from one scan, by a grouped aggregate."""
    values = df.unpivot([], list(categorical), "column", "value")
    return values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def counted_index(df: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows (column, value, n, idx): values by falling frequency, ties in text order, and NULL,
    where it occurs, after the last. For any number of values: nothing but the totals of
    their range partitions meets in one task.
    """
    order = ["column", F.col("value").isNull(), F.desc("n"), "value"]
    numbered = running_before(category_counts(df, categorical), order, F.lit(1), "place")
    # One row per column.
    first = numbered.groupBy("column").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(first), "column").select(
        "column", "value", "n", (F.col("place") - F.col("first")).cast("int").alias("idx")
    )


def category_index(df: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows (column, value, idx) of ``counted_index``."""
    return counted_index(df, categorical).select("column", "value", "idx")


def category_sizes(index: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> dict[str, int]:
    """Number of known values of each column: one row per column comes to the driver."""
    known = index.filter(F.col("value").isNotNull()).groupBy("column").count().collect()
    found = {r["column"]: r["count"] for r in known}
    return {c: found.get(c, 0) for c in categorical}


def with_category_index(
    df: DataFrame, index: DataFrame, sizes: dict[str, int]
) -> DataFrame:
    """Add the index of each category; NULL and unseen values get the one after the last.

    A join per column on its values: Spark broadcasts the index while it is small, and splits
    a value that many rows share where it is not.
    """
    out = df
    for column, size in sizes.items():
        known = index.filter((F.col("column") == column) & F.col("value").isNotNull()).select(
            F.col("value").alias(column), F.col("idx").alias(f"{column}_idx")
        )
        out = out.join(known, column, "left").withColumn(
            f"{column}_idx", F.coalesce(f"{column}_idx", F.lit(size)).cast("double")
        )
    return out.select(*df.columns, *_index(list(sizes)))


def one_hot_encoder(spark: SparkSession, sizes: dict[str, int]) -> OneHotEncoderModel:
    """Vectors with a place for each known value; the index after the last has none."""
    places = spark.range(max(sizes.values(), default=0) + 1).select(
        *[F.least("id", F.lit(n)).cast("double").alias(f"{c}_idx") for c, n in sizes.items()]
    )
    names = list(sizes)
    return OneHotEncoder(inputCols=_index(names), outputCols=_one_hot(names)).fit(places)


def assembler(
    categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC
) -> VectorAssembler:
    return VectorAssembler(
        inputCols=[*_one_hot(categorical), *numeric], outputCol="raw_features"
    )


def scaler() -> StandardScaler:
    """Divides by the sample standard deviation; a constant feature becomes 0."""
    return StandardScaler(
        inputCol="raw_features", outputCol="features", withStd=True, withMean=False
    )


def fitted_scaler(
    df: DataFrame, index: DataFrame, sizes: dict[str, int], numeric: Sequence[str] = NUMERIC
) -> StandardScalerModel:
    """What ``scaler`` learns from the assembled rows, without assembling them.

    The deviation of a place that is 1 for n of N rows follows from the ``counted_index``, those
    of the numbers from one aggregate. The scaler itself learns them from two rows, 0 and the
    deviations times the root of 2; both are as long as the model, which the driver has anyway.
    """
    total = F.count(F.lit(1)).alias("_rows")
    numbers = df.agg(total, *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(c) for c in numeric])
    order = F.create_map(*[F.lit(x) for pair in zip(sizes, range(len(sizes))) for x in pair])
    n, rows = F.col("n").cast("double"), F.col("_rows").cast("double")
    share = F.try_divide(n * (rows - n), rows * (rows - 1))
    hot = (
        index.filter(F.col("value").isNotNull() & F.col("column").isin(list(sizes)))
        .join(F.broadcast(numbers.select("_rows")))
        .select(
            order[F.col("column")].alias("block"),
            "idx",
            F.coalesce(F.sqrt(share), F.lit(0.0)).alias("deviation"),
        )
    )
    given = numbers.select(
        F.lit(len(sizes)).alias("block"), F.posexplode(F.array(*numeric)).alias("idx", "deviation")
    )
    places = F.array_sort(F.collect_list(F.struct("block", "idx", "deviation")))
    two = hot.unionByName(given).agg(places.alias("places")).select(
        F.explode(F.array(F.lit(0.0), F.sqrt(F.lit(2.0)))).alias("times"), "places"
    )
    vector = array_to_vector(F.transform("places", lambda p: p["deviation"] * F.col("times")))
    return scaler().fit(two.select(vector.alias("raw_features")))


def feature_stages(
    spark: SparkSession,
    sizes: dict[str, int],
    numeric: Sequence[str] = NUMERIC,
    scaled: StandardScaler | StandardScalerModel | None = None,
) -> list[Estimator | Transformer]:
    """Stages for a pipeline over rows that have their category index; the last one learns from
    these rows, unless it is given."""
    return [one_hot_encoder(spark, sizes), assembler(list(sizes), numeric), scaled or scaler()]


def hot_positions(df: DataFrame, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows (column, value, idx, hot): where the one-hot vector of each value has its 1, or -1."""
    index = written(category_index(df, categorical), "categories")
    sizes = category_sizes(index, categorical)
    encoder = one_hot_encoder(df.sparkSession, sizes)
    parts = []
    for column in categorical:
        values = df.select(column).distinct().select(
            *[F.col(column) if c == column else F.lit(None).cast("string").alias(c) for c in categorical]
        )
        encoded = encoder.transform(with_category_index(values, index, sizes))
        hot = F.get(F.unwrap_udt(f"{column}_ohe")["indices"], F.lit(0))
        parts.append(
            encoded.select(
                F.lit(column).alias("column"),
                F.col(column).alias("value"),
                F.col(f"{column}_idx").cast("int").alias("idx"),
                F.coalesce(hot, F.lit(-1)).cast("int").alias("hot"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def numeric_block(
    assembled: DataFrame,
    vector: str,
    sizes: dict[str, int],
    numeric: Sequence[str] = NUMERIC,
    digits: int = 6,
) -> DataFrame:
    """The last entries of a feature vector as one column per numeric feature."""
    first = sum(sizes.values())
    last = VectorSlicer(
        inputCol=vector, outputCol="_last", indices=list(range(first, first + len(numeric)))
    )
    cells = vector_to_array("_last")
    return last.transform(assembled).select(
        *[F.round(cells[i], digits).alias(name) for i, name in enumerate(numeric)]
    )
