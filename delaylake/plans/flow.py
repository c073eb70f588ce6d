"""The layers, one after another, each reading the table that the one before wrote.

Every step may be run again: ingest finishes what was cut off and adds what is new in the
source, the bronze stream goes on from its checkpoint and is compared with what was published,
tables are overwritten, and the load empties its table first. A slice that was being sent to Kafka
when a run was cut off is sent again, whole, and landed once.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import FILE_ROWS, SPLIT_SEED, TRAIN_SHARE, LakeConfig
from delaylake.functions.messages import parse_messages
from delaylake.operators import gold, metrics, model, quality, silver, slicing, training_data
from delaylake.plans import generations
from delaylake.plans.ledger import Ledger, run_steps
from delaylake.sources.csv_records import POSITION
from delaylake.sources.jdbc import load_fact
from delaylake.sources.kafka import read_kafka
from delaylake.streaming.bronze import drain_bronze, read_bronze, read_landing
from delaylake.streaming.increments import refine_new
from delaylake.streaming.replay import (
    message_key,
    publish_all,
    publish_slice,
    publishing_began,
    send_slice,
    stage_slices,
)

STEPS = ("ingest", "bronze", "silver", "train", "load")


def ingest(spark: SparkSession, cfg: LakeConfig, records: DataFrame | None = None) -> dict:
    """Slice what the source has new and publish the slices; returns the rows of each slice.

    What is published at one time is a generation, with its own staged records, slices and
    manifest. One that was cut off is finished first, from the records and with the number of
    slices that it began with. After that, new files of a CSV source, or a frame with other
    rows, make the next one; without any, the rows of the last one are reported again.

    Slices that are to be spaced out in time, or sent to Kafka, are staged by slice first
    and published one by one; otherwise one job writes all of them.
    """
    last = generations.last(spark, cfg)
    if last is None or last.finished:
        new = generations.begin(spark, cfg, last, records)
        if new is None:
            return _slice_rows(_sliced(spark, cfg, last)) if last else {}
        last = new
    sliced = _sliced(spark, cfg, last)
    columns = [c for c in sliced.columns if c not in (*POSITION, "slice")]
    landing = generations.folder(cfg.landing, last.number)
    if not (cfg.kafka or cfg.pause_seconds or publishing_began(spark, landing)):
        publish_all(sliced, landing, columns)
    else:
        keyed = sliced.withColumn("key", message_key(last.number, *POSITION))
        staged = stage_slices(
            keyed.drop(*POSITION), generations.folder(cfg.sliced, last.number)
        )
        for number in range(1, last.slices + 1):
            if number > 1:
                time.sleep(cfg.pause_seconds)
            if cfg.kafka:
                sent = generations.folder(cfg.sent, last.number)
                send_slice(staged, number, cfg.kafka, sent, columns)
            else:
                publish_slice(staged, number, landing, columns)
    generations.finish(spark, cfg, last)
    return _slice_rows(sliced)


def _sliced(spark: SparkSession, cfg: LakeConfig, generation: generations.Generation) -> DataFrame:
    table = generations.staged(spark, cfg, generation.number)
    return slicing.assign_slices(table, slicing.cuts_by_position(table, generation.slices))


def _slice_rows(sliced: DataFrame) -> dict[int, int]:
    return {row["slice"]: row["n"] for row in slicing.slice_progress(sliced).collect()}


def land(spark: SparkSession, cfg: LakeConfig) -> int:
    """Land the published messages; returns the rows of the bronze table.

    ``files_per_batch``, or the topic's own limit, bounds a micro-batch, and so what has to
    be landed again after a failure. Messages that were sent to Kafka again are landed once.
    """
    if cfg.kafka:
        source, within = read_kafka(spark, cfg.kafka), cfg.once_within
    else:
        # Files that were published once are landed once by the stream itself.
        source, within = read_landing(spark, cfg.landing, cfg.files_per_batch), None
    drain_bronze(source, cfg.bronze, cfg.bronze_checkpoint, once_within=within)
    landed = read_bronze(spark, cfg.bronze).count()
    published = generations.rows_published(spark, cfg)
    if not cfg.kafka and published is not None and landed != published:
        raise RuntimeError(f"bronze has {landed} rows, but {published} were published")
    return landed


def refine(spark: SparkSession, cfg: LakeConfig) -> int:
    """Bronze to silver; returns the rows of the table."""
    if cfg.incremental:
        refine_new(
            spark, cfg.bronze, cfg.silver, cfg.path("checkpoint/silver"), cfg.path("marts"),
            cfg.files_per_batch,
        )
        return silver.read_silver(spark, cfg.silver).count()
    table = silver.to_silver(parse_messages(read_bronze(spark, cfg.bronze)))
    table, seen = quality.observed(table, {"rows": F.count(F.lit(1))})
    silver.write_silver(table, cfg.silver, cfg.silver_partitions)
    return seen.get["rows"]


def stage_training(
    rows: DataFrame,
    path: str,
    params: model.ModelParams = model.ModelParams(),
    share: float = TRAIN_SHARE,
    random: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows, with nothing but the label and the features.

    Silver has no row key, so the split goes by the whole content of a row. Both sides are
    written by one scan of the wide table; the several scans of the training read the
    narrow one, and do not hash again. With ``random`` each row is drawn by itself.
    """
    if random:
        side = F.rand(SPLIT_SEED) < share
    else:
        content = [F.col(c) for c in silver.SILVER_COLUMNS if c != "ingest_ts"]
        side = training_data.in_training(content, share)
    marked = rows.withColumn("known", side)
    narrow = model.prepare(marked, params).select(
        "label", *params.categorical, *params.numeric, "known"
    )
    files = narrow.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    files.partitionBy("known").parquet(path)
    sides = rows.sparkSession.read.schema(narrow.schema).parquet(path)
    return sides.filter("known").drop("known"), sides.filter("not known").drop("known")


def train(spark: SparkSession, cfg: LakeConfig) -> dict[str, float]:
    """Fit and save the model; returns its metrics on the rows held out."""
    params = model.ModelParams(
        max_iterations=cfg.max_iterations, regularization=cfg.regularization
    )
    if not cfg.use_delays:
        params = params.without_delays()
    rows = silver.read_silver(spark, cfg.silver)
    known, held_out = stage_training(
        rows, cfg.training, params, cfg.train_share, cfg.random_split
    )
    model.save(model.fit(known, params), cfg.model)
    # The saved model carries no training summary, which would go along with every task.
    return metrics.evaluate(model.score(model.load(spark, cfg.model), held_out))


def load(spark: SparkSession, cfg: LakeConfig) -> int:
    """Silver to the fact table, and on to the database if one is configured."""
    fact = gold.to_fact(silver.read_silver(spark, cfg.silver))
    fact, seen = quality.observed(fact, {"rows": F.count(F.lit(1))})
    fact.write.mode("overwrite").parquet(cfg.fact)
    return load_fact(spark.read.parquet(cfg.fact), cfg.jdbc) if cfg.jdbc else seen.get["rows"]


def run_flow(
    spark: SparkSession,
    cfg: LakeConfig,
    records: DataFrame | None = None,
    steps: Iterable[str] = STEPS,
) -> dict:
    """Run the steps in their order; returns what each of them reported.

    With ``cfg.ledger`` a step that fails is tried again, and a run that was cut off is taken up
    at the first step that has not ended, when the same steps are asked for again.
    """
    work = {
        "ingest": lambda: ingest(spark, cfg, records),
        "bronze": lambda: land(spark, cfg),
        "silver": lambda: refine(spark, cfg),
        "train": lambda: train(spark, cfg),
        "load": lambda: load(spark, cfg),
    }
    chosen = set(steps)
    if chosen - set(STEPS):
        raise ValueError(f"unknown steps {sorted(chosen - set(STEPS))}")
    planned = {name: work[name] for name in STEPS if name in chosen}
    if cfg.ledger:
        ledger = Ledger(spark, cfg.path("ledger"))
        return run_steps(ledger, planned, cfg.retries, cfg.retry_seconds)
    return {name: act() for name, act in planned.items()}
