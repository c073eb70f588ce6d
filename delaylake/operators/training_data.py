"""From silver to a labelled, weighted, split training frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.config import SPLIT_SEED, TRAIN_SHARE
from delaylake.functions import rules

# Fixed values
CATEGORICAL = ("origin", "dest", "airline")
NUMERIC = ("distance", "dep_delay", "arr_delay", "day_of_week", "month")
DELAYS = ("dep_delay", "arr_delay")


def with_label(silver: DataFrame) -> DataFrame:
    """Rows with a known flag, and the flag as 0/1 label."""
    known = silver.filter(F.col("cancelled_flag").isNotNull())
    return known.withColumn("label", rules.one_if(F.col("cancelled_flag") == 1))


def fill_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """0 for NULL, and in floating-point columns for NaN too."""
    return df.fillna(0, subset=list(columns))


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def with_class_weight(labelled: DataFrame) -> DataFrame:
    """Weight of the rows with label 1: as many times as the other class is larger."""
    seen = labelled.agg(
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label") == 1).alias("positives"),
    )
    negatives, positives = seen.first()
    if not negatives or not positives:
        raise ValueError(
            f"both classes are needed: {negatives} rows with label 0, {positives} with label 1"
        )
    weight = F.when(F.col("label") == 1, negatives / positives).otherwise(1.0)
    return labelled.withColumn("class_weight", weight)


def in_training(keys: Sequence[Column], share: float = TRAIN_SHARE) -> Column:
    """True for the rows that the md5 of their key puts on the training side."""
    if not 0 < share < 1:
        raise ValueError(f"the share of training rows must lie between 0 and 1, not {share}")
    return rules.hash_bits(*keys) < share * rules.HASH_VALUES


def hash_split(
    df: DataFrame, keys: Sequence[Column], share: float = TRAIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a split that depends on nothing but the row itself.

    A map-only filter: a row is on the same side on every read, whatever the
    partitioning, and equal rows are never on both sides.
    """
    side = in_training(keys, share)
    return df.filter(side), df.filter(~side)


def random_split(
    df: DataFrame, share: float = TRAIN_SHARE, seed: int = SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Spark's random split. It sorts every partition, and the result changes with the
    partitioning, so prefer ``hash_split`` where both sides are read separately."""
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test
