"""One query per operator over the given tables, each a function (spark, sf_dir)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import ONCE_WITHIN, SLICES, TRAIN_SHARE, LakeConfig
from delaylake.functions import rules
from delaylake.functions.messages import MESSAGE_FIELDS, parse_messages, to_messages
from delaylake.operators import (
    features,
    gold,
    layout,
    metrics,
    model,
    newton,
    quality,
    silver,
    slicing,
    training_data,
)
from delaylake.plans import flow
from delaylake.sources.csv_records import read_csv_records, source_row_count
from delaylake.sources.lineitem_records import flight_records, table
from delaylake.streaming.bronze import (
    drain_bronze,
    read_bronze,
    read_keyed_landing,
    read_landing,
)
from delaylake.streaming.increments import merged_mart
from delaylake.streaming.replay import message_key, replay, stage_slices
from delaylake.streaming.scoring import score_new
from delaylake.workspace import fresh_dir, written

LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given table has few row groups, and a scan no more tasks than these; making and parsing
    messages takes far longer than to deal the narrow rows out evenly first."""
    return table(spark, sf_dir, "lineitem").hint("rebalance")


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight_records(lines_of(spark, sf_dir))


def bronze_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_messages(records_of(spark, sf_dir)).withColumnRenamed("value", "json")


def parsed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(bronze_of(spark, sf_dir))


def silver_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.to_silver(parsed_of(spark, sf_dir))


def stored_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver as the later steps get it, from Parquet: the messages are parsed once, and
    filters and column choice reach the scan."""
    return silver.write_silver(silver_of(spark, sf_dir), fresh_dir(spark, "silver"))


def stored_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.to_fact(stored_silver(spark, sf_dir))


def fact_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a single reader, which asks for few columns: nothing is stored on the way, and the filter
    on the date does not parse the messages a second time."""
    parsed = parse_messages(bronze_of(spark, sf_dir), once=True)
    return gold.to_fact(silver.to_silver(parsed))


def labelled_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_data.with_label(silver_of(spark, sf_dir))


def _csv_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "csv")
    records_of(spark, sf_dir).write.options(header=True, quote='"', escape='"').csv(path)
    return read_csv_records(spark, path)


def csv_scan(spark, sf_dir):
    return _csv_copy(spark, sf_dir)


def csv_split_scan(spark, sf_dir):
    """Records with line breaks, marks and commas in quotes, over the ends of the files' splits."""
    path = fresh_dir(spark, "csv_breaks")
    number = F.col("l_linenumber")
    text = (
        F.when(number == 1, "first\nsecond, \"third\"")
        .when(number == 2, F.concat(F.lit("\n\n"), F.repeat(F.lit("long, \"\n"), 20)))
        .when(number == 3, "\"\"")
        .otherwise(F.col("CANCELLATION_REASON"))
    )
    records = flight_records(lines_of(spark, sf_dir), "l_linenumber")
    broken = records.withColumn("CANCELLATION_REASON", text).drop("l_linenumber")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    broken.write.options(header=True, quote='"', escape='"', **keep).csv(path)
    return read_csv_records(spark, path)


def source_rows(spark, sf_dir):
    return source_row_count(_csv_copy(spark, sf_dir))


def _sliced_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return slicing.assign_slices(events, slicing.cuts_by_key(events, ["event_id"], SLICES))


def _slice_ranges(sliced):
    return sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    )


def batch_slices(spark, sf_dir):
    return _slice_ranges(_sliced_events(spark, sf_dir))


def file_slices(spark, sf_dir):
    events = slicing.with_file_position(table(spark, sf_dir, "events"))
    return _slice_ranges(
        slicing.assign_slices(events, slicing.cuts_by_position(events, SLICES))
    )


def batch_progress(spark, sf_dir):
    return slicing.slice_progress(_sliced_events(spark, sf_dir))


def json_envelope(spark, sf_dir):
    """The fields of each message, and its keys: one that is NULL must not be absent."""
    messages = to_messages(records_of(spark, sf_dir))
    keys = F.array_join(F.array_sort(F.json_object_keys("value")), ",")
    return messages.select(
        F.json_tuple("value", *MESSAGE_FIELDS).alias(*MESSAGE_FIELDS), keys.alias("keys")
    )


def bronze_stream(spark, sf_dir):
    home = fresh_dir(spark, "bronze_stream")
    to_messages(records_of(spark, sf_dir)).write.parquet(f"{home}/landing")
    source = read_landing(spark, f"{home}/landing")
    drain_bronze(source, f"{home}/bronze", f"{home}/checkpoint")
    return parse_messages(read_bronze(spark, f"{home}/bronze"))


def bronze_replay(spark, sf_dir):
    """Rows per slice in bronze, after the replay was run twice."""
    home = fresh_dir(spark, "bronze_replay")
    staged = stage_slices(_sliced_events(spark, sf_dir), f"{home}/sliced")
    columns = [c for c in staged.columns if c != "slice"]
    for _ in range(2):
        replay(
            staged,
            SLICES,
            f"{home}/landing",
            f"{home}/bronze",
            f"{home}/checkpoint",
            columns,
            keep=["src_path"],
        )
    number = F.regexp_extract("src_path", "slice=([0-9]+)", 1).cast("int")
    event = F.get_json_object("json", "$.event_id").cast("bigint")
    landed = read_bronze(spark, f"{home}/bronze")
    return _slice_ranges(landed.select(number.alias("slice"), event.alias("event_id")))


def bronze_exactly_once(spark, sf_dir):
    """Rows per slice in bronze, after one slice was sent again to a stream that was stopped in
    between, and another one twice at once."""
    home = fresh_dir(spark, "exactly_once")
    sliced = _sliced_events(spark, sf_dir).withColumn("key", message_key(1, "event_id"))
    columns = [c for c in sliced.columns if c not in ("slice", "key")]
    staged = stage_slices(sliced, f"{home}/sliced")

    def send(rows):
        messages = to_messages(rows, columns, "key").withColumn("timestamp", F.current_timestamp())
        messages.write.mode("append").parquet(f"{home}/landing")

    def land():
        source = read_keyed_landing(spark, f"{home}/landing")
        drain_bronze(
            source, f"{home}/bronze", f"{home}/checkpoint", keep=["key"], once_within=ONCE_WITHIN
        )

    send(staged)
    send(staged.filter(F.col("slice") == 2))
    land()
    send(staged.filter(F.col("slice") == 4))
    land()
    number = F.split("key", "/")[1].cast("int")
    event = F.get_json_object("json", "$.event_id").cast("bigint")
    landed = read_bronze(spark, f"{home}/bronze")
    return _slice_ranges(landed.select(number.alias("slice"), event.alias("event_id")))


def event_json_parse(spark, sf_dir):
    parsed = F.from_json("props", "k string")
    return table(spark, sf_dir, "events").select(
        "event_id", parsed["k"].try_cast("int").alias("k")
    )


def date_parts(spark, sf_dir):
    typed = silver.canonical_columns(parsed_of(spark, sf_dir)).select("flight_date")
    return silver.date_parts(typed)


def canonical_columns(spark, sf_dir):
    return silver.canonical_columns(parsed_of(spark, sf_dir)).select(
        "airline", "origin", "dest", "cancellation_reason"
    )


def numeric_casts(spark, sf_dir):
    return silver.canonical_columns(parsed_of(spark, sf_dir)).select(
        "distance",
        "dep_delay",
        "arr_delay",
        rules.as_number(F.col("cancelled")).alias("cancelled"),
    )


def cancelled_flag(spark, sf_dir):
    return parsed_of(spark, sf_dir).select(
        "CANCELLED", rules.cancelled_flag(F.col("CANCELLED")).alias("cancelled_flag")
    )


def distance_bucket(spark, sf_dir):
    return silver_of(spark, sf_dir).select("distance", "distance_bucket")


def delay_bucket(spark, sf_dir):
    return silver_of(spark, sf_dir).select("dep_delay", "delay_bucket")


def fill_defaults(spark, sf_dir):
    flag = F.when(F.col("CANCELLED") != "", rules.cancelled_flag(F.col("CANCELLED")))
    holes = parsed_of(spark, sf_dir).select(flag.alias("cancelled_flag"))
    return holes.fillna(silver.FILL_DEFAULTS)


def silver_table(spark, sf_dir):
    return stored_silver(spark, sf_dir).drop("ingest_ts")


def silver_by_month(spark, sf_dir):
    """The same table, written in one folder per month and read back."""
    path = fresh_dir(spark, "silver_by_month")
    months = silver.write_silver(silver_of(spark, sf_dir), path, ["year", "month"])
    return months.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cancelled_flag").alias("cancelled")
    )


def _in_two_generations(spark, sf_dir):
    """A lake whose silver was brought up to date after each of two generations."""
    home = fresh_dir(spark, "increments")
    lines = lines_of(spark, sf_dir)
    early = F.col("l_orderkey") % 3 == 0
    cfg = LakeConfig(root=home, incremental=True)
    for part in (lines.filter(early), lines.filter(~early)):
        to_messages(flight_records(part)).write.mode("append").parquet(cfg.landing)
        drain_bronze(read_landing(spark, cfg.landing), cfg.bronze, cfg.bronze_checkpoint)
        flow.refine(spark, cfg)
    return cfg


def silver_incremental(spark, sf_dir):
    cfg = _in_two_generations(spark, sf_dir)
    return silver.read_silver(spark, cfg.silver).drop("ingest_ts")


def mart_route_merged(spark, sf_dir):
    return merged_mart(spark, _in_two_generations(spark, sf_dir).path("marts"), "route")


def mart_airline_merged(spark, sf_dir):
    return merged_mart(spark, _in_two_generations(spark, sf_dir).path("marts"), "airline")


def code_standardize(spark, sf_dir):
    return gold.standard_codes(silver_of(spark, sf_dir)).select("origin", "dest", "airline")


def fact_preview(spark, sf_dir):
    return gold.preview(fact_of(spark, sf_dir))


def stage_counts(spark, sf_dir):
    content = [F.col(c) for c in ("flight_date", "origin", "dest", "airline")]
    return quality.stage_counts(silver_of(spark, sf_dir), training_data.in_training(content))


def observed_counts(spark, sf_dir):
    """As ``stage_counts``, seen by the pass that writes silver."""
    content = [F.col(c) for c in ("flight_date", "origin", "dest", "airline")]
    table, seen = quality.observed_stages(
        silver_of(spark, sf_dir), training_data.in_training(content)
    )
    silver.write_silver(table, fresh_dir(spark, "silver"))
    return spark.createDataFrame(list(seen.get.items()), "stage string, n bigint")


def _damaged(spark, sf_dir):
    """Some numbers are spoiled, and some messages cut short or emptied."""
    lines = lines_of(spark, sf_dir)
    spoiled = F.when(F.col("l_orderkey") % 101 == 0, "late").otherwise(F.col("ARR_DELAY"))
    records = flight_records(lines, "l_orderkey").withColumn("ARR_DELAY", spoiled)
    messages = to_messages(records, MESSAGE_FIELDS)
    damaged = (
        F.when(F.col("value").contains('"DEST":"D7"'), F.substring("value", 1, 20))
        .when(F.col("value").contains('"DEST":"D9"'), F.lit(" "))
        .when(~F.col("value").contains('"DEST":"D11"'), F.col("value"))
    )
    return messages.select(damaged.alias("json"))


def quality_report(spark, sf_dir):
    return quality.quality_report(_damaged(spark, sf_dir))


def quarantine(spark, sf_dir):
    """Rows on both sides, by all their faults; of the accepted ones also how many are cancelled."""
    path = fresh_dir(spark, "routed")
    quality.route_messages(_damaged(spark, sf_dir), path)
    sides = spark.read.parquet(path)
    return sides.groupBy(
        F.col("quarantined").cast("string").alias("quarantined"),
        F.array_join("reasons", ",").alias("reasons"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("json").alias("kept_messages"),
        F.count("flight_date").alias("dated"),
        F.sum("cancelled_flag").alias("cancelled"),
    )


def label_prep(spark, sf_dir):
    return labelled_of(spark, sf_dir).select("cancelled_flag", "label")


def numeric_fill(spark, sf_dir):
    filled = training_data.fill_numeric(silver_of(spark, sf_dir))
    return filled.select(*training_data.NUMERIC)


def class_counts(spark, sf_dir):
    return training_data.class_counts(labelled_of(spark, sf_dir))


def class_weight(spark, sf_dir):
    labelled = training_data.with_label(stored_silver(spark, sf_dir))
    weighted = training_data.with_class_weight(labelled)
    return weighted.groupBy("label", F.round("class_weight", 9).alias("class_weight")).agg(
        F.count(F.lit(1)).alias("n")
    )


def hash_split(spark, sf_dir):
    side = training_data.in_training([F.col(c) for c in LINE_KEY])
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.when(side, "train").otherwise("test").alias("split"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def random_split(spark, sf_dir):
    """Rows on either side and on both, and whether the share is what it should be."""
    labelled = training_data.with_label(stored_silver(spark, sf_dir)).select("label")
    rows = written(labelled.withColumn("id", F.monotonically_increasing_id()), "split")
    train, test = (side.select("id") for side in training_data.random_split(rows))
    sides = written(
        train.withColumn("train", F.lit(1)).unionByName(test.withColumn("train", F.lit(0))), "sides"
    )
    per_row = sides.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("train").alias("train"))
    near = F.abs(F.avg("train") - TRAIN_SHARE) < 0.01
    return per_row.agg(
        F.sum("n").alias("total"),
        F.count_if(F.col("n") > 1).alias("on_both"),
        near.alias("share_is_near"),
    )


def string_index(spark, sf_dir):
    return features.category_index(stored_silver(spark, sf_dir))


def one_hot(spark, sf_dir):
    return features.hot_positions(stored_silver(spark, sf_dir))


def _numeric_features(spark, sf_dir, vector):
    rows = model.prepare(stored_silver(spark, sf_dir))
    index = written(features.counted_index(rows), "categories")
    sizes = features.category_sizes(index)
    if vector == "raw_features":
        stages = features.feature_stages(spark, sizes)[:-1]
    else:
        scaled = features.fitted_scaler(rows, index, sizes)
        stages = features.feature_stages(spark, sizes, scaled=scaled)
    indexed = features.with_category_index(rows, index, sizes)
    assembled = Pipeline(stages=stages).fit(indexed).transform(indexed)
    return features.numeric_block(assembled, vector, sizes)


def assemble_features(spark, sf_dir):
    return _numeric_features(spark, sf_dir, "raw_features")


def scale_features(spark, sf_dir):
    return _numeric_features(spark, sf_dir, "features")


def _fitted(spark, sf_dir):
    known, held_out = flow.stage_training(
        silver_of(spark, sf_dir), fresh_dir(spark, "training")
    )
    path = fresh_dir(spark, "model")
    model.save(model.fit(known), path)
    return model.load(spark, path), known, held_out


def train_model(spark, sf_dir):
    """Of the stored model: what each place of the feature vector stands for, and on how many
    training rows it is not 0 (of a number: is given)."""
    fitted, known, _ = _fitted(spark, sf_dir)
    per_value = features.category_counts(known)
    per_number = known.agg(*[F.count(c).alias(c) for c in training_data.NUMERIC]).unpivot(
        [], list(training_data.NUMERIC), "column", "n"
    )
    rows = per_value.unionByName(per_number.withColumn("value", F.lit(None).cast("string")))
    places = model.feature_positions(fitted).filter(
        F.col("position") < fitted.pipeline.stages[-1].numFeatures
    )
    same = (places["column"] == rows["column"]) & places["value"].eqNullSafe(rows["value"])
    return places.join(rows, same).select(
        F.concat_ws("=", places["column"], places["value"]).alias("feature"), "position", "n"
    )


def score(spark, sf_dir):
    """Per label the held-out rows, and those whose results contradict each other."""
    fitted, _, held_out = _fitted(spark, sf_dir)
    scored = model.score(fitted, held_out)
    by_margin = 1 / (1 + F.exp(-F.col("margin")))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("prediction") == 1) != (F.col("probability") > 0.5)).alias("other_class"),
        F.count_if(~(F.abs(by_margin - F.col("probability")) < 1e-9)).alias("other_margin"),
    )


def model_metrics(spark, sf_dir):
    """Held-out rows per label, and whether the metrics fit each other: weighted recall is the
    share of right predictions, and all lie between 0 and 1."""
    fitted, _, held_out = _fitted(spark, sf_dir)
    scored = written(model.score(fitted, held_out), "scored")
    found = metrics.evaluate(scored)
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    fits = F.abs(right - found["weighted_recall"]) < 1e-9
    return scored.agg(
        F.count_if(F.col("label") == 0).alias("support_0"),
        F.count_if(F.col("label") == 1).alias("support_1"),
        fits.alias("recall_is_accuracy"),
        F.lit(all(0 <= v <= 1 for v in found.values())).alias("all_in_range"),
    )


NEWTON_FEATURES = ("distance", "day_of_week")


def _newton(spark, sf_dir):
    rows = newton.labelled_numbers(silver_of(spark, sf_dir), NEWTON_FEATURES)
    stored = written(rows, "newton_rows")
    return stored, newton.fit_newton(stored, NEWTON_FEATURES)


def logistic_newton(spark, sf_dir):
    """Coefficients on the features divided by their deviations, and the deviations."""
    _, fitted = _newton(spark, sf_dir)
    rows = [("intercept", fitted.intercept, None)]
    rows += zip(fitted.features, fitted.coefficients, fitted.deviations, strict=True)
    found = spark.createDataFrame(rows, "feature string, coefficient double, deviation double")
    return found.select(
        "feature", *[F.round(c, 6).alias(c) for c in ("coefficient", "deviation")]
    )


def logistic_scores(spark, sf_dir):
    """The chance of a cancellation for every combination of features that occurs."""
    rows, fitted = _newton(spark, sf_dir)
    return (
        rows.groupBy(*NEWTON_FEATURES)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("cancelled"))
        .withColumn("probability", F.round(fitted.probability(), 6))
    )


def score_stream(spark, sf_dir):
    """As ``logistic_scores``, of rows that a stream scored in two runs, after silver had grown."""
    home = fresh_dir(spark, "score_stream")
    _, fitted = _newton(spark, sf_dir)

    def score(rows):
        return newton.numbers(rows, NEWTON_FEATURES).withColumn("p", fitted.probability())

    lines = lines_of(spark, sf_dir)
    early = F.col("l_orderkey") % 3 == 0
    for part in (lines.filter(early), lines.filter(~early)):
        messages = to_messages(flight_records(part)).withColumnRenamed("value", "json")
        rows = silver.to_silver(parse_messages(messages))
        rows.write.mode("append").parquet(f"{home}/silver")
        score_new(spark, f"{home}/silver", f"{home}/scores", f"{home}/checkpoint", score)
    return (
        spark.read.parquet(f"{home}/scores")
        .groupBy(*NEWTON_FEATURES)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("label").alias("cancelled"),
            F.round(F.max("p"), 6).alias("probability"),
        )
    )


def _quantity_score(spark, sf_dir):
    """A fixed score in place of a model: returned goods, guessed from the quantity."""
    chance = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select(
        rules.one_if(F.col("l_returnflag") == "R").alias("label"),
        chance.alias("margin"),
        rules.one_if(chance > 0.7).alias("prediction"),
    )


def metric_auc(spark, sf_dir):
    area = metrics.area_under_roc(_quantity_score(spark, sf_dir))
    return area.select(F.round("auc", 9).alias("auc"))


def metric_confusion(spark, sf_dir):
    return metrics.confusion(_quantity_score(spark, sf_dir))


def metric_weighted(spark, sf_dir):
    found = metrics.weighted_metrics(metrics.confusion(_quantity_score(spark, sf_dir)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def mart_airline(spark, sf_dir):
    return gold.mart_airline(fact_of(spark, sf_dir))


def mart_route(spark, sf_dir):
    return gold.mart_route(fact_of(spark, sf_dir))


def _laid_out(spark, sf_dir):
    home = fresh_dir(spark, "fact_by_route")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = home.rsplit("/", 1)[-1].replace("-", "_")
    return layout.lay_out(fact_of(spark, sf_dir), name, home, ("origin", "dest"), buckets)


def mart_route_laid_out(spark, sf_dir):
    """As ``mart_route``, over the fact in buckets by its keys."""
    return gold.mart_route(_laid_out(spark, sf_dir))


def mart_calendar(spark, sf_dir):
    return gold.mart_calendar(fact_of(spark, sf_dir))


def bucket_summary(spark, sf_dir):
    return gold.bucket_summary(fact_of(spark, sf_dir))


def end_to_end(spark, sf_dir):
    """The fact table of a whole run over files, from a CSV source, summarized. The training is
    part of the run."""
    home = fresh_dir(spark, "end_to_end")
    source = f"{home}/source"
    records_of(spark, sf_dir).write.options(header=True, quote='"', escape='"').csv(source)
    cfg = LakeConfig(root=f"{home}/lake", source_csv=source)
    flow.run_flow(spark, cfg)
    return gold.bucket_summary(spark.read.parquet(cfg.fact))


def landed_rows(bronze):
    """Rows, and different rows: told apart by their md5, so that 16 bytes of a message are shuffled
    and not its text."""
    return bronze.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.unhex(F.md5("json"))).alias("n_distinct"),
    )


def reingest(spark, sf_dir):
    """Rows, and different rows, in bronze after a run, after another without anything new, and
    after a third with more files in the source."""
    home = fresh_dir(spark, "reingest")
    source, steps = f"{home}/source", ("ingest", "bronze")
    lines = table(spark, sf_dir, "lineitem")
    early = F.col("l_orderkey") % 3 == 0
    cfg = LakeConfig(root=f"{home}/lake", source_csv=source)
    parts = []
    for run, part in enumerate((lines.filter(early), None, lines.filter(~early)), 1):
        if part is not None:
            records = flight_records(part, *LINE_KEY)
            records.write.mode("append").options(header=True, quote='"', escape='"').csv(source)
        flow.run_flow(spark, cfg, steps=steps)
        landed = landed_rows(read_bronze(spark, cfg.bronze))
        parts.append(written(landed.withColumn("run", F.lit(run)), "reingest"))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "csv_scan": csv_scan,
    "csv_split_scan": csv_split_scan,
    "source_row_count": source_rows,
    "batch_slices": batch_slices,
    "file_slices": file_slices,
    "batch_progress": batch_progress,
    "json_envelope": json_envelope,
    "bronze_stream": bronze_stream,
    "bronze_replay": bronze_replay,
    "bronze_exactly_once": bronze_exactly_once,
    "json_parse": parsed_of,
    "event_json_parse": event_json_parse,
    "date_parts": date_parts,
    "canonical_columns": canonical_columns,
    "numeric_casts": numeric_casts,
    "cancelled_flag": cancelled_flag,
    "distance_bucket": distance_bucket,
    "delay_bucket": delay_bucket,
    "fill_defaults": fill_defaults,
    "silver_table": silver_table,
    "silver_by_month": silver_by_month,
    "silver_incremental": silver_incremental,
    "code_standardize": code_standardize,
    "gold_fact": stored_fact,
    "fact_preview": fact_preview,
    "stage_counts": stage_counts,
    "observed_counts": observed_counts,
    "quality_report": quality_report,
    "quarantine": quarantine,
    "label_prep": label_prep,
    "numeric_fill": numeric_fill,
    "class_counts": class_counts,
    "class_weight": class_weight,
    "hash_split": hash_split,
    "random_split": random_split,
    "string_index": string_index,
    "one_hot": one_hot,
    "assemble_features": assemble_features,
    "scale_features": scale_features,
    "train_model": train_model,
    "score": score,
    "model_metrics": model_metrics,
    "logistic_newton": logistic_newton,
    "logistic_scores": logistic_scores,
    "score_stream": score_stream,
    "metric_auc": metric_auc,
    "metric_confusion": metric_confusion,
    "metric_weighted": metric_weighted,
    "mart_airline": mart_airline,
    "mart_route": mart_route,
    "mart_route_laid_out": mart_route_laid_out,
    "mart_calendar": mart_calendar,
    "bucket_summary": bucket_summary,
    "mart_route_merged": mart_route_merged,
    "mart_airline_merged": mart_airline_merged,
    "end_to_end": end_to_end,
    "reingest": reingest,
}
