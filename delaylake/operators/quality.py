"""Row counts per stage and data checks, each report from one aggregate; the side table of messages
that are no good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from delaylake.functions import rules
from delaylake.functions.messages import UNPARSED, parse_messages
from delaylake.operators import silver as silver_layer

#: What keeps a message out of the fact table.
BLOCKING = ("empty_message", "unparseable", "missing_date", "invalid_date")


def _as_rows(df: DataFrame, counts: dict[str, Column], name: str) -> DataFrame:
    """The aggregates as rows (name, n)."""
    one = df.agg(*[count.alias(label) for label, count in counts.items()])
    return one.unpivot([], list(counts), name, "n")


def _stages(in_training: Column) -> dict[str, Column]:
    return {
        "silver": F.count(F.lit(1)),
        "fact": F.count("flight_date"),
        "train": F.count_if(in_training),
        "test": F.count_if(~in_training),
    }


def stage_counts(silver: DataFrame, in_training: Column) -> DataFrame:
    """Rows in silver, left in the fact table, and on each side of the training split."""
    return _as_rows(silver, _stages(in_training), "stage")


def observed(df: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The frame, and what its first action sees of the counts on the way: a table is counted
    by the pass that writes it. ``Observation.get`` waits for that action."""
    seen = Observation()
    return df.observe(seen, *[count.alias(label) for label, count in counts.items()]), seen


def observed_stages(silver: DataFrame, in_training: Column) -> tuple[DataFrame, Observation]:
    """As ``stage_counts``, of the pass that writes the table."""
    return observed(silver, _stages(in_training))


def _given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def _not_a_number(name: str) -> Column:
    return _given(name) & rules.as_number(F.col(name)).isNull()


def _empty() -> Column:
    """A message without any text, which is neither a record nor a broken one."""
    return F.coalesce(F.trim("json"), F.lit("")) == ""


def _faults() -> dict[str, Column]:
    """What can be wrong with a parsed message, by name."""
    undated = rules.as_date(F.col("FL_DATE")).isNull()
    return {
        "empty_message": _empty(),
        "unparseable": F.col(UNPARSED).isNotNull() & ~_empty(),
        "missing_date": ~F.coalesce(_given("FL_DATE"), F.lit(False)),
        "invalid_date": _given("FL_DATE") & undated,
        "non_numeric_distance": _not_a_number("DISTANCE"),
        "non_numeric_dep_delay": _not_a_number("DEP_DELAY"),
        "non_numeric_arr_delay": _not_a_number("ARR_DELAY"),
        "non_numeric_cancelled": _not_a_number("CANCELLED"),
        "missing_origin": F.col("ORIGIN").isNull(),
        "missing_dest": F.col("DEST").isNull(),
        "missing_airline": F.col("AIRLINE").isNull(),
    }


def quality_report(bronze: DataFrame) -> DataFrame:
    """Counts of messages and of what is missing or malformed in them."""
    faults = {name: F.count_if(fault) for name, fault in _faults().items()}
    undated = rules.as_date(F.col("FL_DATE")).isNull()
    return _as_rows(
        parse_messages(bronze, keep_unparsed=True, keep_message=True),
        {"messages": F.count(F.lit(1)), **faults, "dropped_by_gold": F.count_if(undated)},
        "check",
    )


def route_messages(bronze: DataFrame, path: str, blocking: Sequence[str] = BLOCKING) -> None:
    """Write every message to one of two sides of a table, in one pass.

    A message with a blocking fault is quarantined: it is kept as it came, with the names of all
    its faults. The others are refined, and keep the names of theirs, which do not block.
    """
    parsed = parse_messages(bronze, keep_unparsed=True, keep_message=True, once=True)
    faults = _faults()
    unknown = set(blocking) - set(faults)
    if unknown:
        raise ValueError(f"unknown faults {sorted(unknown)}")
    names = F.array_compact(F.array(*[F.when(f, name) for name, f in faults.items()]))
    marked = parsed.withColumn("reasons", names)
    held = F.arrays_overlap("reasons", F.array(*map(F.lit, blocking)).cast("array<string>"))
    routed = marked.withColumn("quarantined", held)
    refined = silver_layer.to_silver(routed, keep=("json", "reasons", "quarantined"))
    kept = F.when(F.col("quarantined"), F.col("json"))
    refined.withColumn("json", kept).write.mode("overwrite").partitionBy("quarantined").parquet(path)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The silver rows of the messages that were not quarantined."""
    return _routed(spark, path, False).select(*silver_layer.SILVER_COLUMNS)


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined messages, as they came, with the names of their faults."""
    return _routed(spark, path, True).select("json", "reasons")


def _routed(spark: SparkSession, path: str, side: bool) -> DataFrame:
    schema = f"{silver_layer.SILVER_SCHEMA}, json string, reasons array<string>, quarantined boolean"
    return spark.read.schema(schema).parquet(path).where(F.col("quarantined") == side)
