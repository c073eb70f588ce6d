"""Weighted logistic regression by Newton's method, each step one aggregate.

Rows with the same features and label count as one, with the sum of their weights; what a step
needs of them is the weighted sum of the products of every two features, and the weighted sum of
what the model lacks. So p x p numbers reach the driver per step, whatever the number of rows.
The steps are the same in every engine, which a solver with a line search cannot offer.

For numeric features, a few dozen at most: a step sums p(p+1)/2 products. With few different
values the grouped table is small; with many it is as large as the rows, and each step scans it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.config import REGULARIZATION
from delaylake.operators import training_data
from delaylake.workspace import written

STEPS = 8


@dataclass(frozen=True)
class NewtonModel:
    """Coefficients of the features divided by their deviations; one that does not vary is 0."""

    features: tuple[str, ...]
    deviations: tuple[float, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def margin(self) -> Column:
        scaled = _scaled(self.features, self.deviations)
        terms = [F.lit(c) * z for c, z in zip(self.coefficients, scaled, strict=True)]
        return sum(terms, F.lit(self.intercept))

    def probability(self) -> Column:
        """Of label 1."""
        return 1 / (1 + F.exp(-self.margin()))


def _scaled(features: Sequence[str], deviations: Sequence[float]) -> list[Column]:
    return [
        F.col(f).cast("double") / d if d else F.lit(0.0)
        for f, d in zip(features, deviations, strict=True)
    ]


def grouped(rows: DataFrame, features: Sequence[str], weight: str) -> DataFrame:
    """Features, label, and the sum of the weights of the rows that share them, as a table."""
    sums = rows.groupBy(*features, "label").agg(F.sum(weight).alias("_weight"))
    return written(sums, "newton_groups")


def fit_newton(
    rows: DataFrame,
    features: Sequence[str],
    weight: str = "class_weight",
    regularization: float = REGULARIZATION,
    steps: int = STEPS,
) -> NewtonModel:
    """Minimizes the weighted mean of the log loss plus half the regularization times the sum of
    the squared coefficients, without the intercept, from 0 on. Features must not be NULL.
    """
    # Sample deviations, of rows without their weights.
    found = rows.agg(F.count(F.lit(1)), *[F.stddev_samp(f) for f in features]).first()
    if not found[0]:
        raise ValueError("no rows to learn from")
    model = NewtonModel(
        tuple(features), tuple(d or 0.0 for d in found[1:]), 0.0, (0.0,) * len(features)
    )
    groups = grouped(rows, features, weight)
    penalty = regularization * np.diag([0.0] + [1.0] * len(features))
    for _ in range(steps):
        total, lacking, products = _sums(groups, model)
        beta = np.array([model.intercept, *model.coefficients])
        slope = lacking / total - penalty @ beta
        # A feature that does not vary has no slope, and with a penalty no part in the others.
        beta = beta + np.linalg.lstsq(products / total + penalty, slope, rcond=None)[0]
        intercept, *coefficients = beta.tolist()
        model = NewtonModel(model.features, model.deviations, intercept, tuple(coefficients))
    return model


def _sums(groups: DataFrame, model: NewtonModel) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum of weights, what the model lacks per feature, and the products of every two."""
    z = [F.lit(1.0), *_scaled(model.features, model.deviations)]
    with_chance = groups.withColumn("_chance", model.probability())
    weight, chance = F.col("_weight"), F.col("_chance")
    pairs = list(combinations_with_replacement(range(len(z)), 2))
    row = with_chance.agg(
        F.sum(weight),
        *[F.sum(weight * (F.col("label") - chance) * x) for x in z],
        *[F.sum(weight * chance * (1 - chance) * z[i] * z[j]) for i, j in pairs],
    ).first()
    products = np.zeros((len(z), len(z)))
    for (i, j), value in zip(pairs, row[1 + len(z) :], strict=True):
        products[i, j] = products[j, i] = value
    return row[0], np.array(row[1 : 1 + len(z)]), products


def numbers(silver: DataFrame, features: Sequence[str]) -> DataFrame:
    """Label and the numeric features of silver rows, without NULL; also of a stream."""
    labelled = training_data.with_label(silver).select("label", *features)
    return training_data.fill_numeric(labelled, features)


def labelled_numbers(silver: DataFrame, features: Sequence[str]) -> DataFrame:
    """Label, class weight and the numeric features of silver rows, without NULL."""
    return training_data.with_class_weight(numbers(silver, features))
