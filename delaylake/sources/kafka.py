"""Kafka as source and sink of messages.

Needs Spark's Kafka connector on the class path of the cluster; nothing here starts
or contacts a broker before a query runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import KafkaTopic


def source_options(topic: KafkaTopic) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": topic.servers,
        "subscribe": topic.topic,
        "startingOffsets": topic.starting_offsets,
    }
    if topic.max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(topic.max_offsets_per_trigger)
    return options


def sink_options(topic: KafkaTopic) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": topic.servers,
        "topic": topic.topic,
        "kafka.linger.ms": str(topic.linger_ms),
    }


def read_kafka(spark: SparkSession, topic: KafkaTopic) -> DataFrame:
    """Unbounded frame of messages with the payload in ``value``. A message that was sent without
    a ``key`` has its place in the topic as one, so that no two share it."""
    messages = spark.readStream.format("kafka").options(**source_options(topic)).load()
    place = F.concat_ws(":", "topic", "partition", "offset")
    return messages.withColumn("key", F.coalesce(F.col("key").cast("string"), place))


def write_kafka(messages: DataFrame, topic: KafkaTopic) -> None:
    """Send the ``key``, if there is one, and ``value`` of every row; returns when all are
    acknowledged."""
    sent = [c for c in ("key", "value") if c in messages.columns]
    messages.select(*sent).write.format("kafka").options(**sink_options(topic)).save()
