"""Quality of a binary classifier, from counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.operators.ordering import running_before


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows (label, prediction, n)."""
    return scored.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(counts: DataFrame) -> DataFrame:
    """F1, precision and recall, averaged over the labels by their number of rows."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    by_truth = counts.select(
        F.col("label").alias("l"), F.col("n").alias("actual"), zero.alias("said"), hit.alias("hits")
    )
    by_answer = counts.select(
        F.col("prediction").alias("l"), zero.alias("actual"), F.col("n").alias("said"),
        zero.alias("hits"),
    )
    per_label = (
        by_truth.unionByName(by_answer)
        .groupBy("l")
        .agg(*[F.sum(c).alias(c) for c in ("actual", "said", "hits")])
        .filter("actual > 0")
    )
    precision = F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0)
    recall = F.col("hits") / F.col("actual")
    # 2PR/(P+R), written on the counts.
    f1 = 2 * F.col("hits") / (F.col("actual") + F.col("said"))

    def averaged(metric):
        return F.sum(F.col("actual") * metric) / F.sum("actual")

    return per_label.agg(
        averaged(f1).alias("f1"),
        averaged(precision).alias("weighted_precision"),
        averaged(recall).alias("weighted_recall"),
    )


def area_under_roc(scored: DataFrame, label: str = "label", score: str = "margin") -> DataFrame:
    """Exact area under the ROC curve, ties counted half, as one row ``auc``.

    The rows are first reduced to counts per score, so a score that many rows share
    costs one row. NULL when a class is missing.
    """
    positive = F.col(label) == 1
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = running_before(per_score, ["score"], F.col("neg"), "below")
    # Twice the number of ordered pairs, whole numbers up to the division.
    pairs = F.sum(
        F.col("pos").cast("decimal(38,0)") * (2 * F.col("below") + F.col("neg"))
    )
    everything = (2 * F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("all")
    return ranked.agg(pairs.cast("double").alias("pairs"), everything).select(
        F.try_divide("pairs", "all").alias("auc")
    )


def evaluate(scored: DataFrame) -> dict[str, float]:
    """AUC, F1, weighted precision and recall of scored rows, which are computed once."""
    kept = scored.select("label", "prediction", "margin").persist()
    try:
        weighted = weighted_metrics(confusion(kept)).first().asDict()
        return {"auc": area_under_roc(kept).first()["auc"], **weighted}
    finally:
        kept.unpersist()
