"""Newton's method against MLlib run to its end, and against the equations themselves."""

import math
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from delaylake.operators import newton
from delaylake.plans import checks

FEATURES = ["a", "b", "c"]


def some_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.randrange(6), rng.gauss(3, 2), rng.choice([0.0, 10.0])
        label = int(rng.random() < 1 / (1 + math.exp(2 - 0.4 * a + 0.3 * b - 0.05 * c)))
        rows.append((label, 2.5 if label else 1.0, a, b, c))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, class_weight double, a int, b double, c double")


@pytest.mark.parametrize("regularization", [0.01, 0.3])
def test_same_as_a_solver_run_to_its_end(spark, regularization):
    rows = frame(spark, some_rows())
    found = newton.fit_newton(rows, FEATURES, regularization=regularization, steps=12)
    raw = VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="scaled").fit(raw)
    solver = LogisticRegression(
        featuresCol="scaled", weightCol="class_weight", regParam=regularization, maxIter=500,
        tol=1e-14, standardization=False,
    )
    wanted = solver.fit(scaler.transform(raw))
    assert found.deviations == pytest.approx(list(scaler.std), rel=1e-12)
    assert found.intercept == pytest.approx(wanted.intercept, abs=1e-6)
    assert list(found.coefficients) == pytest.approx(list(wanted.coefficients), abs=1e-6)


def test_probabilities_and_the_slope_at_the_end(spark):
    rows = some_rows(200, 2)
    found = newton.fit_newton(frame(spark, rows), FEATURES, regularization=0.05, steps=15)
    scored = frame(spark, rows).withColumn("p", found.probability()).collect()
    total = sum(r.class_weight for r in scored)
    for i, name in enumerate(FEATURES):
        lacking = sum(
            r.class_weight * (r.label - r.p) * r[name] / found.deviations[i] for r in scored
        )
        assert lacking / total == pytest.approx(0.05 * found.coefficients[i], abs=1e-9)
    assert sum(r.class_weight * (r.label - r.p) for r in scored) == pytest.approx(0, abs=1e-7)


def test_rows_alike_count_as_one(spark):
    rows = [(r[0], r[1], r[2], 0.0, r[4]) for r in some_rows(500, 3)]
    groups = newton.grouped(frame(spark, rows * 3), ["a", "c"], "class_weight")
    assert groups.count() <= 24
    once = newton.fit_newton(frame(spark, rows), ["a", "c"])
    often = newton.fit_newton(frame(spark, rows * 3), ["a", "c"])
    # The sample deviation of more rows is a little smaller; margins stay nearly the same.
    assert often.intercept == pytest.approx(once.intercept, abs=1e-3)


def test_a_feature_that_does_not_vary(spark):
    rows = [(r[0], r[1], r[2], 7.0, r[4]) for r in some_rows(300, 4)]
    found = newton.fit_newton(frame(spark, rows), FEATURES)
    without = newton.fit_newton(frame(spark, rows), ["a", "c"])
    assert abs(found.coefficients[1]) < 1e-20 and found.deviations[1] == 0
    assert found.intercept == pytest.approx(without.intercept, abs=1e-9)
    assert frame(spark, rows).select(F.max(F.abs(found.margin() - without.margin()))).first()[0] < 1e-9


def test_no_rows_are_refused(spark):
    with pytest.raises(ValueError, match="no rows"):
        newton.fit_newton(frame(spark, []), FEATURES)


def test_missing_numbers_are_zero(spark):
    silver = checks.silver_of(spark, "/root/testdata/sf0.001")
    rows = newton.labelled_numbers(silver, ["distance", "dep_delay"])
    assert rows.columns == ["label", "distance", "dep_delay", "class_weight"]
    assert rows.where("distance is null or dep_delay is null").count() == 0
    assert rows.count() == silver.count()


def test_a_step_is_one_aggregate(spark):
    groups = newton.grouped(frame(spark, some_rows(50)), FEATURES, "class_weight")
    model = newton.NewtonModel(tuple(FEATURES), (1.0, 1.0, 1.0), 0.0, (0.1, 0.2, 0.3))
    total, lacking, products = newton._sums(groups, model)
    assert total == pytest.approx(sum(r[1] for r in some_rows(50)))
    assert lacking.shape == (4,) and products.shape == (4, 4)
    assert (products == products.T).all()
