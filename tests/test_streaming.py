from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from delaylake.config import KafkaTopic
from delaylake.functions.messages import to_messages
from delaylake.operators import slicing
from delaylake.sources import kafka
from delaylake.streaming import bronze
from delaylake.streaming import replay as replaying
from delaylake.streaming.replay import publish_slice, replay, stage_slices


def messages(spark, n):
    return to_messages(spark.range(n).select(F.col("id").cast("string").alias("ORIGIN")))


def test_landing_twice_adds_nothing_and_new_files_are_added(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "ck"))
    messages(spark, 100).write.parquet(landing)
    for expected in (100, 100):
        query = bronze.drain_bronze(bronze.read_landing(spark, landing), table, checkpoint)
        assert query.exception() is None
        assert bronze.read_bronze(spark, table).columns == ["json"]
        assert bronze.read_bronze(spark, table).count() == expected
    messages(spark, 20).write.mode("append").parquet(landing)
    bronze.drain_bronze(bronze.read_landing(spark, landing), table, checkpoint)
    assert bronze.read_bronze(spark, table).count() == 120


def test_binary_payload_and_provenance(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "ck"))
    payload = spark.createDataFrame([(bytearray("žluť".encode()), "t", 3)], "value binary, topic string, offset bigint")
    payload.write.parquet(landing)
    stream = spark.readStream.schema(payload.schema).parquet(landing)
    bronze.drain_bronze(stream, table, checkpoint, keep=["topic", "offset"])
    assert [tuple(r) for r in bronze.read_bronze(spark, table).collect()] == [("žluť", "t", 3)]


def test_running_stream_ends_when_told(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / d) for d in ("in", "out", "ck"))
    messages(spark, 10).write.parquet(landing)
    query = bronze.follow_bronze(bronze.read_landing(spark, landing), table, checkpoint)
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert bronze.read_bronze(spark, table).count() == 10


def test_replay_lands_one_slice_per_micro_batch(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(103).select("id", F.lit("x").alias("other")).coalesce(3).write.parquet(source)
    rows = slicing.with_file_position(spark.read.parquet(source))
    sliced = slicing.assign_slices(rows, slicing.cuts_by_position(rows, 10))
    staged = stage_slices(sliced.select("id", "other", "slice"), str(tmp_path / "staged"))
    places = [str(tmp_path / d) for d in ("landing", "bronze", "checkpoint")]
    queries = replay(staged, 10, *places, columns=["id", "other"], keep=["src_path"])
    batches = [
        (p["batchId"], p["numInputRows"])
        for q in queries
        for p in q.recentProgress
        if p["numInputRows"]
    ]
    assert batches == [(i, 10) for i in range(9)] + [(9, 13)]
    landed = bronze.read_bronze(spark, places[1])
    slices = Counter(r.src_path.split("slice=")[1].split("/")[0] for r in landed.collect())
    assert slices == {**{str(i): 10 for i in range(1, 10)}, "10": 13}
    # Again: nothing is published or landed a second time.
    replay(staged, 10, *places, columns=["id", "other"], keep=["src_path"])
    ids = landed.select(F.get_json_object("json", "$.id").cast("int").alias("i"))
    assert sorted(r.i for r in ids.collect()) == list(range(103))
    assert bronze.read_bronze(spark, places[1]).count() == 103


def test_a_slice_left_half_published_is_written_again(spark, tmp_path):
    staged = spark.range(10).withColumn("slice", F.lit(1))
    landing = str(tmp_path / "landing")
    publish_slice(staged, 1, landing, ["id"])
    (tmp_path / "landing" / "slice=1" / "_SUCCESS").rename(tmp_path / "moved")
    publish_slice(staged, 1, landing, ["id"])
    assert spark.read.parquet(landing).count() == 10


def test_slices_are_sent_once_and_again_only_after_a_failure(spark, tmp_path, monkeypatch):
    staged = spark.range(20).withColumn("slice", (F.col("id") / 10).cast("int") + 1)
    topic, sent, got = KafkaTopic("broker:9092", "records"), str(tmp_path / "sent"), []

    def broker(messages, _):
        got.append(messages.count())
        if len(got) == 2:
            raise OSError("broker is gone")

    monkeypatch.setattr(replaying, "write_kafka", broker)
    assert replaying.send_slice(staged, 1, topic, sent, ["id"])
    with pytest.raises(OSError):
        replaying.send_slice(staged, 2, topic, sent, ["id"])
    again = [replaying.send_slice(staged, n, topic, sent, ["id"]) for n in (1, 2)]
    assert again == [False, True] and got == [10, 10, 10]


def test_kafka_options():
    topic = KafkaTopic("broker:9092", "records", max_offsets_per_trigger=1000)
    assert kafka.source_options(topic) == {
        "kafka.bootstrap.servers": "broker:9092",
        "subscribe": "records",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "1000",
    }
    assert kafka.sink_options(topic) == {
        "kafka.bootstrap.servers": "broker:9092",
        "topic": "records",
        "kafka.linger.ms": "50",
    }


def keyed(spark, keys, at, path):
    rows = [(f"message {k}", k, at) for k in keys]
    frame = spark.createDataFrame(rows, "value string, key string, timestamp timestamp")
    frame.coalesce(1).write.mode("append").parquet(path)


def landed_keys(spark, places):
    source = bronze.read_keyed_landing(spark, places[0])
    bronze.drain_bronze(source, places[1], places[2], keep=["key"], once_within="2 hours")
    return sorted(r.key for r in bronze.read_bronze(spark, places[1]).collect())


def test_a_message_sent_again_is_landed_once(spark, tmp_path):
    places = [str(tmp_path / d) for d in ("in", "out", "ck")]
    start = datetime(2024, 1, 1)
    keyed(spark, ["a", "b", "a"], start, places[0])
    assert landed_keys(spark, places) == ["a", "b"]
    # After a restart, with new ones beside it.
    keyed(spark, ["b", "c"], start + timedelta(hours=1), places[0])
    assert landed_keys(spark, places) == ["a", "b", "c"]
    assert landed_keys(spark, places) == ["a", "b", "c"]


def test_keys_are_forgotten_so_that_the_state_stays_bounded(spark, tmp_path):
    places = [str(tmp_path / d) for d in ("in", "out", "ck")]
    start, kept = datetime(2024, 1, 1), []
    for day in range(4):
        keyed(spark, [f"{day}-{i}" for i in range(50)], start + timedelta(days=day), places[0])
        source = bronze.read_keyed_landing(spark, places[0])
        query = bronze.drain_bronze(
            source, places[1], places[2], keep=["key"], once_within="2 hours"
        )
        progress = query.lastProgress
        kept.append(sum(op["numRowsTotal"] for op in progress["stateOperators"]))
    assert bronze.read_bronze(spark, places[1]).count() == 200
    assert max(kept) <= 100


def test_messages_sent_to_kafka_have_their_key(spark, tmp_path, monkeypatch):
    rows = spark.range(6).withColumn("slice", F.lit(1))
    staged = rows.withColumn("key", replaying.message_key(3, "id"))
    got = []
    monkeypatch.setattr(
        replaying, "write_kafka", lambda m, _: got.append({r.key: r.value for r in m.collect()})
    )
    for folder in ("sent", "sent again"):
        topic = KafkaTopic("broker:9092", "records")
        replaying.send_slice(staged, 1, topic, str(tmp_path / folder), ["id"])
    assert got[0] == got[1] == {f"3/1/{i}": f'{{"id":{i}}}' for i in range(6)}
