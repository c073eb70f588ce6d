"""What the plans must look like to hold at a large scale."""

import re

import pytest

import __spark_entry__ as contract
from delaylake.functions.messages import parse_messages
from delaylake.operators import gold, metrics, silver, slicing, training_data
from delaylake.plans import checks
from delaylake.plans.flow import stage_training
from delaylake.streaming import bronze as bronze_stream
from delaylake.streaming import replay
from delaylake.workspace import fresh_dir
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return checks.stored_silver(spark, SF)


@pytest.fixture(scope="module")
def bronze(spark):
    path = fresh_dir(spark, "bronze")
    checks.bronze_of(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_silver_is_one_map_stage_with_one_parse(bronze):
    text = plan(silver.to_silver(parse_messages(bronze)))
    assert "Exchange" not in text and text.count("from_json(") == 1
    assert "Python" not in text and "BatchEval" not in text


def test_only_the_needed_json_fields_are_parsed(bronze):
    text = plan(silver.to_silver(parse_messages(bronze)).select("flight_date", "year"))
    assert "FL_DATE" in text and "AIRLINE" not in text


def test_fact_filter_and_columns_reach_the_scan(stored):
    text = plan(gold.to_fact(stored))
    assert "PushedFilters: [IsNotNull(flight_date)]" in text
    assert "Exchange" not in text
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "ingest_ts" not in schema and "cancellation_reason" not in schema


def test_summaries_aggregate_before_their_shuffle(stored):
    for mart in (gold.mart_airline, gold.mart_route, gold.mart_calendar):
        text = plan(mart(gold.to_fact(stored)))
        assert text.count("Exchange") == 1 and text.count("partial_count") >= 1


@pytest.mark.parametrize(
    "name", ["mart_airline", "mart_route", "mart_calendar", "bucket_summary", "fact_preview"]
)
def test_summaries_parse_each_message_once(spark, name):
    assert plan(contract.queries()[name](spark, SF)).count("from_json(") == 1


def test_month_filter_prunes_folders(spark, stored):
    months = silver.write_silver(stored, fresh_dir(spark, "m"), ["year", "month"])
    text = plan(months.filter("year = 1996 and month = 2"))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*month", text)


def test_slices_and_splits_are_maps(spark):
    events = slicing.with_file_position(checks.table(spark, SF, "events"))
    sliced = slicing.assign_slices(events, slicing.cuts_by_position(events, 10))
    assert "Exchange" not in plan(sliced)
    for side in training_data.hash_split(events, [F.col("event_id")]):
        assert "Exchange" not in plan(side)


def test_preview_needs_no_full_sort(stored):
    text = plan(gold.preview(gold.to_fact(stored)))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_training_reads_the_narrow_table_of_one_side(spark, stored):
    known, held_out = stage_training(stored, fresh_dir(spark, "t"))
    text = plan(known.select("label"))
    assert "PartitionFilters: [isnotnull(known" in text and "md5" not in text
    assert "ReadSchema: struct<label:int>" in text
    assert known.count() + held_out.count() == stored.count()


def test_area_under_roc_has_no_window_over_everything(spark):
    text = plan(metrics.area_under_roc(checks._quantity_score(spark, SF)))
    # The one window without a partition runs over the totals per range partition.
    assert "windowspecdefinition(_part" in text
    assert text.count("Window [") == 2 and "BroadcastHashJoin" in text


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_no_query_joins_everything_with_everything(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_messages_are_stored_and_told_apart_by_little(spark, tmp_path):
    sliced = spark.range(20).select((F.col("id") % 2).alias("slice"), F.col("id").cast("string"))
    replay.publish_all(sliced, f"{tmp_path}/landing", ["id"])
    source = bronze_stream.read_landing(spark, f"{tmp_path}/landing")
    bronze_stream.drain_bronze(source, f"{tmp_path}/bronze", f"{tmp_path}/checkpoint")
    for table in ("landing", "bronze"):
        files = [p.name for p in (tmp_path / table).rglob("*.parquet")]
        assert files and all(n.endswith(".zstd.parquet") for n in files)
    read = bronze_stream.read_bronze(spark, f"{tmp_path}/bronze")
    counted = checks.landed_rows(read)
    assert tuple(counted.first()) == (20, 20)
    assert re.search(r"hashpartitioning\(\w*unhex", plan(counted))
