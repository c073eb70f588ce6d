"""Publishing a sliced source as messages, at once or replayed slice by slice."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from delaylake.config import MESSAGE_CODEC, KafkaTopic
from delaylake.functions.messages import to_messages
from delaylake.sources.kafka import write_kafka
from delaylake.streaming.bronze import drain_bronze, read_landing


def message_key(generation: int, *place: str) -> Column:
    """What tells a message from all others, and is the same when it is sent again: the
    generation, the slice, and the columns that say which row of the source it is."""
    return F.concat_ws("/", F.lit(generation), "slice", *place)


def stage_slices(sliced: DataFrame, path: str) -> DataFrame:
    """Write the rows by slice, so that each slice can be read on its own.

    No shuffle: with slices in file order a task meets one slice, seldom two.
    """
    sliced.write.mode("overwrite").partitionBy("slice").parquet(path)
    return sliced.sparkSession.read.schema(sliced.schema).parquet(path)


def _published(spark: SparkSession, folder: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def publishing_began(spark: SparkSession, landing: str) -> bool:
    """True if slices have been published one by one here, perhaps not all of them."""
    return _published(spark, f"{landing}/slice=1")


def publish_all(sliced: DataFrame, landing: str, columns: Iterable[str]) -> None:
    """Write all slices as messages, in one job, each in its own folder of ``landing``."""
    if _published(sliced.sparkSession, landing):
        return
    messages = to_messages(sliced, columns, "slice")
    messages.write.mode("overwrite").partitionBy("slice").parquet(landing, compression=MESSAGE_CODEC)


def publish_slice(staged: DataFrame, number: int, landing: str, columns: Iterable[str]) -> bool:
    """Write one slice as messages below ``landing``; True if it was not there yet.

    A slice that is there stays as it is, since files written again under new names would
    be landed a second time.
    """
    folder = f"{landing}/slice={number}"
    if any(_published(staged.sparkSession, f) for f in (landing, folder)):
        return False
    rows = staged.filter(F.col("slice") == number)
    messages = to_messages(rows, columns)
    messages.write.mode("overwrite").parquet(folder, compression=MESSAGE_CODEC)
    return True


def send_slice(
    staged: DataFrame, number: int, topic: KafkaTopic, sent: str, columns: Iterable[str]
) -> bool:
    """Send one slice to Kafka, unless a marker below ``sent`` says that all of it was.

    The marker is written when every message is acknowledged. A run that is cut off in a
    slice sends that slice, and none before it, again; by their ``key`` (see ``message_key``)
    its messages are known as the same.
    """
    marker = f"{sent}/slice={number}"
    if _published(staged.sparkSession, marker):
        return False
    rows = staged.filter(F.col("slice") == number)
    write_kafka(to_messages(rows, columns, *(["key"] if "key" in rows.columns else [])), topic)
    rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(marker)
    return True


def replay(
    staged: DataFrame,
    slices: int,
    landing: str,
    bronze: str,
    checkpoint: str,
    columns: Iterable[str],
    pause_seconds: float = 0.0,
    keep: Iterable[str] = (),
) -> list[StreamingQuery]:
    """Publish and land slice after slice; returns the ended queries of the landings.

    Landing a slice before the next one is published keeps the stream from falling
    behind, so a pause is not needed; it only spaces the slices out in time.
    """
    columns, landed = list(columns), []
    for number in range(1, slices + 1):
        if number > 1 and pause_seconds:
            time.sleep(pause_seconds)
        new = publish_slice(staged, number, landing, columns)
        # A run that was cut off may have left a slice published but not landed, which
        # the next landing takes along; so the last one is done in any case.
        if new or number == slices:
            messages = read_landing(staged.sparkSession, landing)
            landed.append(drain_bronze(messages, bronze, checkpoint, keep=keep))
    return landed
