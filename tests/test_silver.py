import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from delaylake.functions.messages import MESSAGE_FIELDS, parse_messages, to_messages
from delaylake.operators import silver
from delaylake.operators.gold import to_fact


def silver_of(spark, *messages):
    bronze = spark.createDataFrame([(m,) for m in messages], "json string")
    return silver.to_silver(parse_messages(bronze)).collect()


def one(spark, **fields):
    return silver_of(spark, json.dumps(fields))[0]


def test_schema(spark):
    bronze = spark.createDataFrame([("{}",)], "json string")
    table = silver.to_silver(parse_messages(bronze))
    assert tuple(table.columns) == silver.SILVER_COLUMNS
    types = dict(table.dtypes)
    assert types["flight_date"] == "date" and types["ingest_ts"] == "timestamp"
    assert {types[c] for c in ("year", "month", "day_of_week", "cancelled_flag")} == {"int"}
    assert {types[c] for c in ("distance", "dep_delay", "arr_delay")} == {"double"}


@pytest.mark.parametrize("value", ["1192.0", 1192.0])
def test_numbers_quoted_and_bare(spark, value):
    assert one(spark, DISTANCE=value).distance == 1192.0


@pytest.mark.parametrize("message", ["not json", "", None])
def test_malformed_message_is_kept(spark, message):
    (row,) = silver_of(spark, message)
    assert row.flight_date is None and row.airline is None and row.distance is None
    assert (row.cancelled_flag, row.distance_bucket, row.delay_bucket) == (0, "LONG", "UNKNOWN")


def test_malformed_message_is_left_out_of_the_fact_table(spark):
    bronze = spark.createDataFrame([("x",), ('{"FL_DATE":"2019-01-09"}',)], "json string")
    assert to_fact(silver.to_silver(parse_messages(bronze))).count() == 1


def test_keys_are_case_sensitive(spark):
    assert one(spark, fl_date="2019-01-09").flight_date is None


def test_text_after_the_object_is_ignored(spark):
    (row,) = silver_of(spark, '{"ORIGIN":"A"}{"ORIGIN":"B"}')
    assert row.origin == "A"


@pytest.mark.parametrize(
    "text",
    ["2019-01-09", "2019-1-9", "2019-01-09 00:00:00", "2019-01-09T10:11:12", " 2019-01-09 "],
)
def test_dates(spark, text):
    assert one(spark, FL_DATE=text).flight_date == dt.date(2019, 1, 9)


@pytest.mark.parametrize("text", ["bad", "", "2019-02-30", "1/9/2019 12:00:00 AM"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_dates_do_not_raise(spark, text, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        row = one(spark, FL_DATE=text, CANCELLED=text, DISTANCE=text)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert row.flight_date is None and row.year is None
    assert row.cancelled_flag == 0 and row.distance is None


@pytest.mark.parametrize("text, day", [("2024-01-07", 1), ("2024-01-06", 7)])
def test_weekday_starts_on_sunday(spark, text, day):
    assert one(spark, FL_DATE=text).day_of_week == day


@pytest.mark.parametrize("value", ["1.0", "1", " 1.0 ", 1])
def test_flag_set(spark, value):
    assert one(spark, CANCELLED=value).cancelled_flag == 1


@pytest.mark.parametrize("value", ["0.0", "", "true", "NaN", None])
def test_flag_not_set(spark, value):
    assert one(spark, CANCELLED=value).cancelled_flag == 0


@pytest.mark.parametrize(
    "value, bucket",
    [
        ("299.9", "SHORT"), ("300", "MEDIUM"), ("799.9", "MEDIUM"), ("800", "LONG"),
        ("-5", "SHORT"), (None, "LONG"), ("NaN", "LONG"),
    ],
)
def test_distance_bucket(spark, value, bucket):
    assert one(spark, DISTANCE=value).distance_bucket == bucket


@pytest.mark.parametrize(
    "value, bucket",
    [("-4", "ONTIME"), ("15", "ONTIME"), ("15.1", "DELAYED"), (None, "UNKNOWN"), ("NaN", "DELAYED")],
)
def test_delay_bucket(spark, value, bucket):
    assert one(spark, DEP_DELAY=value).delay_bucket == bucket


def test_load_time_can_be_given(spark):
    bronze = spark.createDataFrame([("{}",)], "json string")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    row = silver.to_silver(parse_messages(bronze), ingest_ts=at).first()
    assert row.ingest_ts == dt.datetime(2024, 5, 6, 7, 8, 9)


def test_messages_keep_null_fields_and_odd_text(spark):
    values = ['quote " and \\ slash', "two\nlines", "žluťoučký 東京", None, "", "x", "1", "2", "3"]
    schema = ", ".join(f"{c} string" for c in MESSAGE_FIELDS)
    records = spark.createDataFrame([tuple(values)], schema)
    messages = to_messages(records)
    assert json.loads(messages.first().value) == dict(zip(MESSAGE_FIELDS, values))
    parsed = parse_messages(messages.withColumnRenamed("value", "json")).first()
    assert list(parsed) == values


def test_write_twice_and_by_month(spark, tmp_path):
    bronze = spark.createDataFrame(
        [('{"FL_DATE":"2024-0%d-01"}' % (i % 3 + 1),) for i in range(30)] + [("x",)], "json string"
    )
    table = silver.to_silver(parse_messages(bronze))
    for keys in ((), ("year", "month")):
        for _ in range(2):
            stored = silver.write_silver(table, str(tmp_path / "-".join(("t", *keys))), keys)
        assert stored.count() == 31
        assert stored.filter("cancelled_flag not in (0, 1) or cancelled_flag is null").count() == 0
    assert (tmp_path / "t-year-month" / "year=2024" / "month=1").is_dir()


def test_streaming_frame_is_accepted(spark, tmp_path):
    bronze = spark.createDataFrame([('{"ORIGIN":"A"}',)], "json string")
    bronze.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("json string").parquet(str(tmp_path / "in"))
    query = (
        silver.to_silver(parse_messages(stream))
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().origin == "A"


def test_nan_is_not_lost(spark):
    assert math.isnan(one(spark, ARR_DELAY="NaN").arr_delay)
