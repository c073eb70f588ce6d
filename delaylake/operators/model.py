"""Training and applying the cancellation model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import MAX_ITERATIONS, REGULARIZATION
from delaylake.operators import training_data
from delaylake.operators.features import (
    category_sizes,
    counted_index,
    feature_stages,
    fitted_scaler,
    with_category_index,
)
from delaylake.workspace import fresh_dir, written


@dataclass(frozen=True)
class ModelParams:
    categorical: tuple[str, ...] = training_data.CATEGORICAL
    numeric: tuple[str, ...] = training_data.NUMERIC
    max_iterations: int = MAX_ITERATIONS
    regularization: float = REGULARIZATION

    def without_delays(self) -> ModelParams:
        """A cancelled flight has no delay, so the delays give the label away."""
        kept = tuple(c for c in self.numeric if c not in training_data.DELAYS)
        return replace(self, numeric=kept)


def prepare(silver: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Label and features of the rows to learn from, before the split."""
    labelled = training_data.with_label(silver)
    return training_data.fill_numeric(labelled, params.numeric)


@dataclass(frozen=True)
class CancellationModel:
    """The index of the categories, as a table, and the stages from there on."""

    categories: DataFrame
    sizes: dict[str, int]
    pipeline: PipelineModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(with_category_index(rows, self.categories, self.sizes))


def fit(train: DataFrame, params: ModelParams = ModelParams()) -> CancellationModel:
    """Weighted logistic regression over one-hot categories and scaled numbers.

    Scans: one for the classes, one for the category values, one for the numbers' deviations, and
    of the assembled rows those of the solver: one for its own deviations, and one to fill the
    blocks that it caches for its iterations.
    """
    needed = train.select("label", *params.categorical, *params.numeric)
    weighted = training_data.with_class_weight(needed)
    categories = written(counted_index(needed, params.categorical), "categories")
    sizes = category_sizes(categories, params.categorical)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="class_weight",
        maxIter=params.max_iterations,
        regParam=params.regularization,
    )
    scaled = fitted_scaler(needed, categories, sizes, params.numeric)
    stages = feature_stages(train.sparkSession, sizes, params.numeric, scaled)
    indexed = with_category_index(weighted, categories, sizes)
    fitted = Pipeline(stages=[*stages, regression]).fit(indexed)
    return CancellationModel(categories, sizes, _without_summary(train.sparkSession, fitted))


def _without_summary(spark: SparkSession, fitted: PipelineModel) -> PipelineModel:
    """The fitted regression holds its training rows' plan, which would go along with every task
    that scores; the stored one does not."""
    *stages, regression = fitted.stages
    path = fresh_dir(spark, "regression")
    regression.write().save(path)
    return PipelineModel([*stages, LogisticRegressionModel.load(path)])


def save(model: CancellationModel, path: str) -> None:
    """The stages, and beside them the categories with the number of each column's values."""
    sizes = F.create_map(*[F.lit(x) for pair in model.sizes.items() for x in pair])
    model.categories.select("column", "value", "idx").write.mode("overwrite").parquet(
        f"{path}/categories"
    )
    model.categories.sparkSession.range(1).select(
        F.array(*map(F.lit, model.sizes)).alias("columns"), sizes.alias("sizes")
    ).write.mode("overwrite").parquet(f"{path}/sizes")
    model.pipeline.write().overwrite().save(f"{path}/stages")


def load(spark: SparkSession, path: str) -> CancellationModel:
    row = spark.read.parquet(f"{path}/sizes").first()
    return CancellationModel(
        spark.read.parquet(f"{path}/categories"),
        {c: row["sizes"][c] for c in row["columns"]},
        PipelineModel.load(f"{path}/stages"),
    )


def score(model: CancellationModel, rows: DataFrame) -> DataFrame:
    """The rows with ``prediction`` and ``probability`` of a cancellation."""
    scored = model.transform(rows)
    chance = vector_to_array("probability")[1]
    margin = vector_to_array("rawPrediction")[1]
    return scored.select(
        *[F.col(c) for c in rows.columns],
        margin.alias("margin"),
        chance.alias("probability"),
        "prediction",
    )


def feature_positions(
    model: CancellationModel, numeric: Sequence[str] = training_data.NUMERIC
) -> DataFrame:
    """Rows (column, value, position): what each place of the feature vector stands for. The
    value is NULL for a numeric feature."""
    first, offsets = 0, []
    for column, size in model.sizes.items():
        offsets += [F.lit(column), F.lit(first)]
        first += size
    offset = F.create_map(*offsets)[F.col("column")]
    hot = model.categories.filter(F.col("value").isNotNull()).select(
        "column", "value", (F.col("idx") + offset).cast("int").alias("position")
    )
    numbers = model.categories.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, numeric))).alias("i", "column")
    )
    return hot.unionByName(
        numbers.select(
            "column",
            F.lit(None).cast("string").alias("value"),
            (F.col("i") + first).cast("int").alias("position"),
        )
    )


def coefficients(
    model: CancellationModel, params: ModelParams = ModelParams()
) -> list[tuple[str, float]]:
    """(feature, coefficient) pairs, intercept first. They are as many as the model has, and
    so they come to the driver, where the coefficients are already."""
    regression = model.pipeline.stages[-1]
    places = feature_positions(model, params.numeric).orderBy("position").collect()
    names = [r["column"] if r["value"] is None else f"{r['column']}={r['value']}" for r in places]
    weights = [float(w) for w in regression.coefficients]
    return [
        ("intercept", float(regression.intercept)), *zip(names, weights, strict=True)
    ]
