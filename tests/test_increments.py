"""Silver and summaries by batch: replayed, added to, merged."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from delaylake.config import LakeConfig
from delaylake.functions.messages import to_messages
from delaylake.operators import gold, silver
from delaylake.plans import checks, flow
from delaylake.streaming import increments
from delaylake.streaming.bronze import drain_bronze, read_landing

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.drop("ingest_ts").collect())


def files_below(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


@pytest.fixture(scope="module")
def bronze(spark):
    return checks.bronze_of(spark, SF)


def land(spark, cfg, messages):
    messages.withColumnRenamed("json", "value").write.mode("append").parquet(cfg.landing)
    drain_bronze(read_landing(spark, cfg.landing), cfg.bronze, cfg.bronze_checkpoint)


def test_a_replayed_batch_replaces_itself(spark, bronze, tmp_path):
    path, marts = str(tmp_path / "silver"), str(tmp_path / "marts")
    parts = bronze.randomSplit([0.5, 0.5], seed=1)
    for number, part in enumerate(parts):
        increments.refine_batch(part, number, path, marts)
    before = rows_of(silver.read_silver(spark, path))
    merged = rows_of(increments.merged_mart(spark, marts, "route"))
    # As after a failure between the write and the commit, and half way through the write.
    increments.refine_batch(parts[1].limit(10), 1, path, marts)
    assert rows_of(silver.read_silver(spark, path)) != before
    increments.refine_batch(parts[1], 1, path, marts)
    assert rows_of(silver.read_silver(spark, path)) == before
    assert rows_of(increments.merged_mart(spark, marts, "route")) == merged
    assert before == rows_of(checks.silver_of(spark, SF))


def test_only_what_is_new_is_read_and_written(spark, bronze, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), incremental=True)
    places = cfg.bronze, cfg.silver, cfg.path("checkpoint/silver"), cfg.path("marts")
    first, second = bronze.limit(4000), bronze.limit(300)
    land(spark, cfg, first)
    query = increments.refine_new(spark, *places)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 4000
    there = files_below(cfg.silver) | files_below(cfg.path("marts"))
    land(spark, cfg, second)
    query = increments.refine_new(spark, *places)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 300
    after = files_below(cfg.silver) | files_below(cfg.path("marts"))
    assert there.items() <= after.items() and len(after) > len(there)
    # Without anything new, nothing is written.
    query = increments.refine_new(spark, *places)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 0
    assert files_below(cfg.silver) | files_below(cfg.path("marts")) == after
    assert silver.read_silver(spark, cfg.silver).count() == 4300


def test_files_per_batch_bounds_a_batch(spark, bronze, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), incremental=True, files_per_batch=1)
    bronze.limit(100).repartition(3).write.parquet(cfg.bronze)
    assert flow.refine(spark, cfg) == 100
    parts = [d for d in os.listdir(cfg.silver) if d.startswith("batch=")]
    assert len(parts) == 3


@pytest.mark.parametrize("name", list(increments.MARTS))
def test_merged_is_the_same_as_from_the_fact(spark, name):
    """Missing delays, groups in one part only, and parts without rows."""
    rows = [("A", "B", "X", None, 1.0, 1), ("A", "B", "X", 3.0, None, 0), ("A", "C", "Y", None, None, 0)]
    fact = spark.createDataFrame(
        rows, "origin string, dest string, airline string, dep_delay double, arr_delay double, "
        "cancelled_flag int",
    ).withColumn("delay_bucket", F.when(F.col("dep_delay") > 2, "DELAYED").otherwise("UNKNOWN"))
    keys = increments.MARTS[name]
    parts = [fact.where("cancelled_flag = 1"), fact.where("cancelled_flag = 0"), fact.limit(0)]
    states = parts[0].transform(gold.partial_summary, *keys)
    for part in parts[1:]:
        states = states.unionByName(gold.partial_summary(part, *keys))
    whole = {"airline": gold.mart_airline, "route": gold.mart_route}[name](fact)
    merged = gold.merge_summaries(states, *keys)
    assert merged.columns == whole.columns
    assert rows_of(merged) == rows_of(whole)


def test_the_whole_flow_over_increments(spark, tmp_path):
    cfg = LakeConfig(root=str(tmp_path / "lake"), incremental=True)
    records = checks.records_of(spark, SF).limit(500)
    for _ in range(2):
        found = flow.run_flow(spark, cfg, records, steps=("ingest", "bronze", "silver", "load"))
        assert found["silver"] == 500
    fact = spark.read.parquet(cfg.fact)
    assert found["load"] == fact.count()
    assert rows_of(increments.merged_mart(spark, cfg.path("marts"), "route")) == rows_of(
        gold.mart_route(fact)
    )


def test_messages_that_are_no_records_are_kept(spark, tmp_path):
    messages = spark.createDataFrame([("not json",), (None,), ("{}",)], "json string")
    path, marts = str(tmp_path / "silver"), str(tmp_path / "marts")
    increments.refine_batch(messages, 0, path, marts)
    assert silver.read_silver(spark, path).count() == 3
    # None of them is in the fact table, so there are no states yet.
    increments.refine_batch(to_messages(checks.records_of(spark, SF)).toDF("json"), 1, path, marts)
    assert rows_of(increments.merged_mart(spark, marts, "airline")) == rows_of(
        checks.mart_airline(spark, SF)
    )
