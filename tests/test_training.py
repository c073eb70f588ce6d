import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from delaylake.operators import features, metrics, model, training_data

SILVER = (
    "origin string, dest string, airline string, distance double, dep_delay double, "
    "arr_delay double, day_of_week int, month int, cancelled_flag int"
)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    made = []
    for i in range(600):
        origin = draw.choice(["AAA", "BBB", "CCC"])
        distance = draw.uniform(50, 2000)
        chance = 1 / (1 + math.exp(-(distance - 1400) / 300 + (origin == "AAA")))
        made.append(
            (
                origin, draw.choice(["X", "Y"]), draw.choice(["p", "q", "r", None]), distance,
                draw.gauss(5, 10) if i % 9 else None, draw.gauss(3, 10),
                draw.randint(1, 7), draw.randint(1, 12), int(draw.random() < chance),
            )
        )
    return made


@pytest.fixture(scope="module")
def silver(spark, rows):
    return spark.createDataFrame(rows, SILVER)


def test_label_drops_unknown_flags(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "cancelled_flag int")
    assert sorted(r.label for r in training_data.with_label(df).collect()) == [0, 1]


def test_fill(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), 1.5, None, 3)],
        "distance double, dep_delay double, arr_delay double, day_of_week int, month int",
    )
    assert tuple(training_data.fill_numeric(df).first()) == (0.0, 0.0, 1.5, 0, 3)


def test_class_weight(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 4, "label int")
    found = {r.label: r.class_weight for r in training_data.with_class_weight(df).collect()}
    assert found == {0: 1.0, 1: 1.5}
    counts = {r.label: r.n for r in training_data.class_counts(df).collect()}
    assert counts == {0: 6, 1: 4}


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only_is_refused(spark, label):
    with pytest.raises(ValueError, match="both classes"):
        training_data.with_class_weight(spark.createDataFrame([(label,)], "label int"))


def test_hash_split_is_complete_and_stable(spark):
    df = spark.range(5000)
    key = [F.col("id")]
    train, test = training_data.hash_split(df, key)
    ids = {r.id for r in train.collect()}
    assert ids.isdisjoint(r.id for r in test.collect())
    assert train.count() + test.count() == 5000 and 3800 < train.count() < 4200
    again, _ = training_data.hash_split(df.repartition(13), key)
    assert {r.id for r in again.collect()} == ids


def test_random_split_is_complete(spark):
    train, test = training_data.random_split(spark.range(1000))
    assert train.count() + test.count() == 1000


def test_category_index(spark, silver, rows):
    found = {(r.column, r.value): r.idx for r in features.category_index(silver).collect()}
    for i, column in enumerate(training_data.CATEGORICAL):
        values = [r[i] for r in rows]
        known = sorted(set(values) - {None}, key=lambda v: (-values.count(v), v))
        expected = {(column, v): j for j, v in enumerate(known)}
        if None in values:
            expected[column, None] = len(known)
        assert {k: v for k, v in found.items() if k[0] == column} == expected


def test_unseen_and_missing_categories_share_the_last_index(spark, silver):
    index = features.category_index(silver, ["origin"])
    sizes = features.category_sizes(index, ["origin"])
    odd = spark.createDataFrame([(None,), ("ZZZ",), ("AAA",)], "origin string")
    indexed = features.with_category_index(odd, index, sizes)
    found = {
        r.origin: (r.origin_idx, list(r.origin_ohe.toArray()))
        for r in features.one_hot_encoder(spark, sizes).transform(indexed).collect()
    }
    assert found[None] == found["ZZZ"] == (3.0, [0.0, 0.0, 0.0])
    assert sum(found["AAA"][1]) == 1.0


def test_hot_positions(spark, silver):
    rows = features.hot_positions(silver).collect()
    found = {(r.column, r.value): (r.idx, r.hot) for r in rows}
    assert found["airline", None] == (3, -1)
    assert {c for c, _ in found} == set(training_data.CATEGORICAL)
    assert all(idx == hot for (_, value), (idx, hot) in found.items() if value)


def test_layout_of_the_vector(spark, silver, rows):
    prepared = model.prepare(silver)
    fitted = model.fit(prepared)
    places = {(r.column, r.value): r.position for r in model.feature_positions(fitted).collect()}
    assert sorted(places.values()) == list(range(len(places)))
    assert len(places) == fitted.pipeline.stages[-1].numFeatures
    for r in fitted.transform(prepared).limit(50).collect():
        cells = r.raw_features.toArray()
        expected = {places[c, r[c]]: 1.0 for c in training_data.CATEGORICAL if r[c] is not None}
        expected |= {places[c, None]: float(r[c]) for c in training_data.NUMERIC}
        assert [(i, x) for i, x in enumerate(cells) if x] == [
            (i, x) for i, x in sorted(expected.items()) if x
        ]


def test_very_many_categories(spark):
    rows = spark.range(60_000).selectExpr(
        "cast(id as string) as origin", "'x' as dest", "cast(id % 3 as string) as airline",
        "1.0 as distance", "0.0 as dep_delay", "0.0 as arr_delay", "1 as day_of_week",
        "1 as month", "cast(id % 2 as int) as cancelled_flag",
    )
    params = model.ModelParams(max_iterations=2)
    fitted = model.fit(model.prepare(rows, params), params)
    assert fitted.sizes == {"origin": 60_000, "dest": 1, "airline": 3}


@pytest.mark.parametrize("share", [0, 1, -0.5, 1.5])
def test_share_outside_of_0_and_1_is_refused(spark, share):
    with pytest.raises(ValueError, match="share"):
        training_data.in_training([F.col("id")], share)


def test_share_is_not_rounded(spark):
    left = spark.range(100_000).filter(~training_data.in_training([F.col("id")], 0.996)).count()
    assert 300 < left < 500


def test_scaling(spark):
    df = spark.createDataFrame(
        [(Vectors.dense(float(x), 5.0),) for x in (1, 2, 4, 9)], ["raw_features"]
    )
    scaled = features.scaler().fit(df).transform(df).collect()
    deviation = statistics.stdev([1, 2, 4, 9])
    assert [r.features[0] for r in scaled] == pytest.approx([x / deviation for x in (1, 2, 4, 9)])
    assert all(r.features[1] == 0.0 for r in scaled)


def by_newton(x, y, weights, penalty):
    """Weighted logistic loss + penalty/2 * |w|^2 (mean over the weights), intercept free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    theta, share = np.zeros(a.shape[1]), weights / weights.sum()
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ theta))
        gradient = a.T @ (share * (p - y)) + ridge @ theta
        theta -= np.linalg.solve((a.T * (share * p * (1 - p))) @ a + ridge, gradient)
    return theta


def test_model_against_newton(spark, silver, rows):
    params = model.ModelParams(max_iterations=200)
    prepared = model.prepare(silver, params)
    fitted = model.fit(prepared, params)
    found = dict(model.coefficients(fitted, params))

    names = [n for n in found if n != "intercept"]
    columns = {"origin": 0, "dest": 1, "airline": 2}
    numbers = {"distance": 3, "dep_delay": 4, "arr_delay": 5, "day_of_week": 6, "month": 7}
    raw = np.array(
        [
            [
                float(r[numbers[n]] or 0) if n in numbers
                else float(r[columns[n.split("=")[0]]] == n.split("=")[1])
                for n in names
            ]
            for r in rows
        ]
    )
    y = np.array([r[8] for r in rows])
    weights = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    x = raw / raw.std(axis=0, ddof=1)
    # The solver penalizes features standardized by their weighted deviation.
    mean = (weights @ x) / weights.sum()
    spread = np.sqrt(weights @ (x - mean) ** 2 / (weights.sum() - (weights @ weights) / weights.sum()))
    theta = by_newton(x / spread, y, weights, params.regularization)
    expected = np.append(theta[:-1] / spread, theta[-1])
    assert [*[found[n] for n in names], found["intercept"]] == pytest.approx(expected, abs=2e-3)


def test_empty_category_is_a_value_of_its_own(spark, silver):
    some = silver.withColumn("origin", F.when(F.col("origin") != "AAA", F.col("origin")).otherwise(""))
    fitted = model.fit(model.prepare(some))
    names = [n for n, _ in model.coefficients(fitted)]
    assert "origin=" in names and len([n for n in names if n.startswith("origin=")]) == 3


def test_scores_survive_saving(spark, silver, tmp_path):
    prepared = model.prepare(silver)
    fitted = model.fit(prepared)
    model.save(fitted, str(tmp_path / "m"))
    model.save(fitted, str(tmp_path / "m"))
    scores = [
        sorted(r.probability for r in model.score(m, prepared).select("probability").collect())
        for m in (fitted, model.load(spark, str(tmp_path / "m")))
    ]
    assert scores[0] == scores[1] and all(0 <= p <= 1 for p in scores[0])


def test_a_stream_is_scored_like_a_table(spark, silver, tmp_path):
    prepared = model.prepare(silver)
    model.save(model.fit(prepared), str(tmp_path / "m"))
    fitted = model.load(spark, str(tmp_path / "m"))
    silver.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(silver.schema).parquet(str(tmp_path / "in"))
    query = (
        model.score(fitted, model.prepare(stream))
        .select("probability")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    scores = [
        sorted(r.probability for r in df.select("probability").collect())
        for df in (spark.read.parquet(str(tmp_path / "out")), model.score(fitted, prepared))
    ]
    assert scores[0] == scores[1]


def test_model_without_delays(spark, silver):
    params = model.ModelParams().without_delays()
    fitted = model.fit(model.prepare(silver, params), params)
    names = [n for n, _ in model.coefficients(fitted, params)]
    assert "distance" in names and not set(names) & set(training_data.DELAYS)


@pytest.fixture(scope="module")
def guesses(spark):
    draw = random.Random(3)
    made = []
    for i in range(3000):
        label = int(draw.random() < 0.3)
        # A third of the rows share one score.
        margin = 0.25 if i % 3 == 0 else round(draw.gauss(label, 1.5), 2)
        made.append((label, float(margin > 0.5), margin))
    return made


@pytest.fixture(scope="module")
def scored(spark, guesses):
    return spark.createDataFrame(guesses, "label int, prediction double, margin double")


def test_auc_by_all_pairs_and_by_evaluator(spark, scored, guesses):
    ours = metrics.area_under_roc(scored).first().auc
    positive = [m for label, _, m in guesses if label]
    negative = np.sort([m for label, _, m in guesses if not label])
    pairs = sum(
        (np.searchsorted(negative, m, "left") + np.searchsorted(negative, m, "right")) / 2
        for m in positive
    )
    assert ours == pytest.approx(pairs / len(positive) / len(negative), abs=1e-12)
    vectors = scored.select(
        "label", array_to_vector(F.array(-F.col("margin"), "margin")).alias("rawPrediction")
    )
    evaluator = BinaryClassificationEvaluator(numBins=0)
    assert ours == pytest.approx(evaluator.evaluate(vectors), abs=1e-9)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5)], "label int, margin double")
    assert metrics.area_under_roc(df).first().auc is None


def test_weighted_metrics_match_the_evaluator(scored):
    found = metrics.evaluate(scored)
    for name, metric in (
        ("f1", "f1"),
        ("weighted_precision", "weightedPrecision"),
        ("weighted_recall", "weightedRecall"),
    ):
        evaluator = MulticlassClassificationEvaluator(metricName=metric)
        assert found[name] == pytest.approx(evaluator.evaluate(scored), abs=1e-12)


def test_label_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 0.0)], "label int, prediction double")
    found = metrics.weighted_metrics(metrics.confusion(df)).first()
    for name, metric in (("f1", "f1"), ("weighted_precision", "weightedPrecision")):
        evaluator = MulticlassClassificationEvaluator(metricName=metric)
        assert found[name] == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_scaler_from_counts_is_that_of_the_assembled_rows(spark, silver):
    """Also of a constant number, a value that all rows have, and NULL as a value."""
    rows = model.prepare(silver).withColumns({"month": F.lit(3), "dest": F.lit("X")})
    index = features.counted_index(rows).cache()
    sizes = features.category_sizes(index)
    stages = features.feature_stages(spark, sizes)
    indexed = features.with_category_index(rows, index, sizes)
    for some in (indexed, indexed.limit(1).cache()):
        known = features.counted_index(some)
        there = features.category_sizes(known)
        if there != sizes:
            stages = features.feature_stages(spark, there)
            some = features.with_category_index(some.select(rows.columns), known, there)
        assembled = Pipeline(stages=stages[:-1]).fit(some).transform(some)
        found = features.fitted_scaler(some, known, there)
        assert list(found.std) == pytest.approx(list(stages[-1].fit(assembled).std), rel=1e-12)
        assert found.std[sizes["origin"] if some is indexed else 1] == 0.0


def test_fit_scans_the_assembled_rows_for_the_solver_only(spark, silver, monkeypatch):
    seen, fit = [], features.StandardScaler.fit

    def watched(self, rows, *args):
        seen.append(rows.count())
        return fit(self, rows, *args)

    monkeypatch.setattr(features.StandardScaler, "fit", watched)
    fitted = model.fit(model.prepare(silver))
    assert seen == [2]
    assert not fitted.pipeline.stages[-1].hasSummary
