"""Scores for what is new in silver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from delaylake.operators import silver


def score_new(
    spark: SparkSession,
    table: str,
    path: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the scores of the silver rows that have no score yet to the table at ``path``; returns
    the ended query.

    ``score`` maps rows to scored rows. It may join them with stored tables, such as the saved
    category index of a model, which are read anew by each call; it must not aggregate them.
    Silver has to grow by whole files, as by ``refine_new``.
    """
    reader = spark.readStream.schema(silver.SILVER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(table).select(*silver.SILVER_COLUMNS)
    query = (
        score(rows)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
