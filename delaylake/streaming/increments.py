"""Silver and summaries that take only what is new in bronze.

A stream follows the bronze table, and each of its micro-batches becomes one part of the silver
table, in a folder named by the number of the batch. A batch that is run again, after a failure,
has the same number and the same messages, and replaces its part. So do the partial states of the
summaries, which hold counts and sums; a summary is merged from the states alone and
reads no fact row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from delaylake.functions.messages import parse_messages
from delaylake.operators import gold, silver

#: Keys of each summary.
MARTS: Mapping[str, Sequence[str]] = {"airline": ("airline",), "route": ("origin", "dest")}


def _write_part(rows: DataFrame, number: int, path: str) -> None:
    """The rows as the part of batch ``number``, in place of what is there of it."""
    # A batch without rows leaves its folder as it was, which then is not there either.
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def refine_batch(messages: DataFrame, number: int, path: str, marts: str | None = None) -> None:
    """Messages to one part of silver at ``path``, and of the states below ``marts``."""
    _write_part(silver.to_silver(parse_messages(messages)), number, path)
    if marts is None:
        return
    stored = silver.read_silver(messages.sparkSession, path, f"batch = {int(number)}")
    fact = gold.to_fact(stored)
    for name, keys in MARTS.items():
        _write_part(gold.partial_summary(fact, *keys), number, f"{marts}/{name}")


def refine_new(
    spark: SparkSession,
    bronze: str,
    path: str,
    checkpoint: str,
    marts: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take what bronze has new to silver, and to the states of the summaries; returns the ended
    query. ``files_per_batch`` bounds a batch, and so what is done again after a failure."""
    reader = spark.readStream.schema("json string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(bronze)
        .writeStream.foreachBatch(lambda rows, n: refine_batch(rows, n, path, marts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def merged_mart(spark: SparkSession, marts: str, name: str) -> DataFrame:
    """The summary, from the states of all batches."""
    states = spark.read.parquet(f"{marts}/{name}").drop("batch")
    return gold.merge_summaries(states, *MARTS[name])
