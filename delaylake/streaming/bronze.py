"""Bronze: messages landed unchanged by a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from delaylake.config import FILE_ROWS, MESSAGE_CODEC, PAUSE_SECONDS


def read_landing(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Unbounded frame over the Parquet files of messages that appear below ``path``.

    Columns ``value``, and ``src_path`` with the file that a message came in.
    """
    reader = spark.readStream.schema("value string").option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select("value", F.col("_metadata.file_path").alias("src_path"))


def read_keyed_landing(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_landing``, of messages with a ``key`` and the ``timestamp`` of their sending."""
    schema = "value string, key string, timestamp timestamp"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return reader.parquet(path).select("value", "key", "timestamp")


def first_of_each_key(messages: DataFrame, within: str) -> DataFrame:
    """Of the messages with one ``key`` the first that arrives.

    What is sent again up to ``within`` (such as '1 day') after the first time, by the messages'
    own ``timestamp``, is left out, also after a restart. Keys older than that are forgotten, which
    bounds the state; a message that comes so late that newer ones have passed it by more
    than ``within`` is left out too, so choose it well above any delay of a slice.
    """
    return messages.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["key"])


def start_bronze(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    keep: Iterable[str] = (),
    seconds: float | None = None,
    once_within: str | None = None,
) -> StreamingQuery:
    """Append the text of every message, once, to Parquet.

    The stream itself lands what it is given once; with ``once_within`` a message that was sent
    several times under the same ``key`` is landed once too (see ``first_of_each_key``).

    The table has the one column ``json``, and columns named in ``keep`` (such as topic,
    partition, offset, timestamp) to tell where a message came from. By default the query
    takes what is there and ends; ``seconds`` makes it run on, one micro-batch per period.
    """
    if seconds is None:
        trigger = {"availableNow": True}
    else:
        trigger = {"processingTime": f"{seconds} seconds"}
    if once_within:
        messages = first_of_each_key(messages, once_within)
    return (
        messages.select(F.col("value").cast("string").alias("json"), *keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("compression", MESSAGE_CODEC)
        .option("maxRecordsPerFile", FILE_ROWS)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def follow_bronze(messages: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """As ``start_bronze``, running on with the usual period between micro-batches."""
    return start_bronze(messages, path, checkpoint, seconds=PAUSE_SECONDS, **options)


def drain_bronze(messages: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Land what is there; returns the ended query. Landing again adds only what is new."""
    query = start_bronze(messages, path, checkpoint, **options)
    query.awaitTermination()
    return query


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
