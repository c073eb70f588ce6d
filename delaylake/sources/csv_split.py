"""Delimited text with line breaks in quotes, read by many tasks.

Whether a line begins inside a cell in quotes depends on all that comes before it in its file. So
every line is looked at for both cases: it leads from outside to outside or inside, and
from inside to either. Such steps can be put together: of the lines in a split that make one step,
and of the splits in a file, whose steps tell where each split begins. Then every split finds its
records by itself, as its lines are read; only the lines of those that go over its end, at most two
pieces for a split, are shuffled and joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylake.workspace import written

# A cell in quotes up to its closing mark. Marks inside it are doubled; possessive, so that a
# doubled mark at the end of a line does not close the cell.
INSIDE = r'[^"]*+(?:""[^"]*+)*+'
OPEN = f'"{INSIDE}'
CLOSED = f'{OPEN}"'
# Whole cells, and then one in quotes that goes on in the next line. A mark within a cell that
# does not begin with one is plain text.
_TO_OPEN = rf'(?:[^",][^,]*+,|{CLOSED}[^,]*+,|,)*+{OPEN}\z'
#: A line that ends inside quotes, if it begins outside or inside.
GOES_ON = f"^{_TO_OPEN}"
STAYS_INSIDE = rf'^{INSIDE}(?:\z|"[^,]*+,{_TO_OPEN})'

_SPLIT = ("src_file", "src_block")


def _lines(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """Lines with their file, split and number, and where a line ends by where it begins."""
    marked = F.col("value").contains('"')
    return spark.read.text(files).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        "value",
        marked.alias("marked"),
        (marked & F.col("value").rlike(GOES_ON)).alias("from_outside"),
        (~marked | F.col("value").rlike(STAYS_INSIDE)).alias("from_inside"),
    )


def _steps_so_far(steps: DataFrame, group: tuple[str, ...], order: str) -> DataFrame:
    """Each step together with all before it in its group.

    Of these only the last one that ends in the same place from both sides counts, and whether
    the number of steps after it that change the place is odd.
    """
    in_order = Window.partitionBy(*group).orderBy(order)
    changes = F.col("from_outside") != F.col("from_inside")
    swaps = F.count_if(~F.col("from_inside") & F.col("from_outside")).over(in_order)
    last = F.last(F.when(~changes, F.struct("from_outside", "swaps")), True).over(in_order)
    odd = (F.col("swaps") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1

    def ends(begins: bool) -> Column:
        return F.coalesce("last.from_outside", F.lit(begins)) != odd

    return (
        steps.withColumn("swaps", swaps)
        .withColumn("last", last)
        .withColumns({"from_outside": ends(False), "from_inside": ends(True)})
        .drop("swaps", "last")
    )


def _after(outside: np.ndarray, inside: np.ndarray, begins: bool) -> np.ndarray:
    """Whether each line ends inside quotes, given where it ends by where it begins."""
    same, swaps = outside == inside, np.cumsum(outside & ~inside)
    last = np.maximum.accumulate(np.where(same, np.arange(len(same)), -1))
    known = last >= 0
    since = swaps - np.where(known, swaps[last], 0)
    return np.where(known, outside[last], begins) != (since % 2 == 1)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


_STEP = (
    "split long, from_outside boolean, from_inside boolean, leads long, opens_outside long, "
    "opens_inside long"
)
_FLAGS = ("from_outside", "from_inside")


def _split_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step of each split, from its lines with marks, which come in order. ``leads`` is its first
    line that begins outside if it begins inside itself; ``opens`` is where the record begins
    that goes over its end, by where the split begins."""
    schema = pa.schema([("split", pa.int64()), *[(n, pa.bool_()) for n in _FLAGS]]
                       + [(n, pa.int64()) for n in ("leads", "opens_outside", "opens_inside")])
    split, ends, leads, opens = None, [False, True], None, [None, None]

    def found(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)

    def step() -> list:
        return [split, *ends, leads, *[o if e else None for o, e in zip(opens, ends)]]

    for batch in batches:
        splits, row, outside, inside = _columns(batch, "split", "src_row", *_FLAGS)
        cuts = np.flatnonzero(splits[1:] != splits[:-1]) + 1
        done = []
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(splits)], strict=True):
            if i == j:
                continue
            if split != int(splits[i]):
                if split is not None:
                    done.append(step())
                split, ends, leads, opens = int(splits[i]), [False, True], None, [None, None]
            for k in (0, 1):
                after = _after(outside[i:j], inside[i:j], ends[k])
                before = np.concatenate([[ends[k]], after[:-1]])
                if k and leads is None and not after.all():
                    leads = int(row[i + np.argmin(after)]) + 1
                begun = np.flatnonzero(after & ~before)
                if len(begun):
                    opens[k] = int(row[i + begun[-1]])
                ends[k] = bool(after[-1])
        if done:
            yield found(done)
    if split is not None:
        yield found([step()])


def split_starts(lines: DataFrame) -> DataFrame:
    """Whether each split of each file begins inside quotes, and which of its lines belong to whole
    records: those from ``body`` up to before ``opens``. The rows of the result are as many as the
    splits, and only they are shuffled."""
    split = F.xxhash64(*_SPLIT).alias("split")
    steps = lines.where("marked").select(split, "src_row", *_FLAGS).mapInArrow(_split_steps, _STEP)
    text = F.min(F.when(F.trim("value") != "", F.col("src_row")))
    all_splits = lines.groupBy(*_SPLIT).agg(
        F.min("src_row").alias("low"), F.max("src_row").alias("high"), text.alias("text")
    )
    whole = all_splits.withColumn("split", split).join(steps, "split", "left")
    placed = whole.withColumns(
        {
            "ends_outside": F.coalesce("from_outside", F.lit(False)),
            "ends_inside": F.coalesce("from_inside", F.lit(True)),
        }
    ).withColumns({"from_outside": F.col("ends_outside"), "from_inside": F.col("ends_inside")})
    in_order = Window.partitionBy("src_file").orderBy("src_block")
    all_of_it = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = F.col("begins_inside")
    opens = F.when(begins, F.col("opens_inside")).otherwise(F.col("opens_outside"))
    begun = F.when(F.col("opens").isNotNull(), F.struct("src_block", F.col("opens").alias("src_row")))
    return (
        _steps_so_far(placed, ("src_file",), "src_block")
        .withColumn("begins_inside", F.lag("from_outside", 1, False).over(in_order))
        .withColumn("opens", opens)
        .select(
            *_SPLIT, "split", "begins_inside", "low", "high", "opens",
            F.when(begins, F.col("leads")).otherwise(F.col("low")).alias("body"),
            # Where the record began that goes on into the split.
            F.last(begun, True)
            .over(in_order.rowsBetween(Window.unboundedPreceding, -1))
            .alias("goes_on"),
            # A record has text if its first line has, so the header is the first such line.
            F.first("text", True).over(all_of_it).alias("header"),
        )
    )


def _whole_records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of lines that come in order, and of which the first begins outside."""
    open_at, parts = None, []
    names = ["split", "src_row", "record"]
    for batch in batches:
        if not batch.num_rows:
            continue
        split, row, value = (batch.column(n) for n in ("split", "src_row", "value"))
        after = _after(*_columns(batch, *_FLAGS), open_at is not None)
        before = np.concatenate([[open_at is not None], after[:-1]])
        first = np.flatnonzero(~before).astype(np.int32)
        if open_at is not None:
            parts.append(value.slice(0, first[0] if len(first) else len(value)))
            if not len(first) and after[-1]:
                continue
            lines = pa.concat_arrays(parts)
            listed = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
            yield pa.RecordBatch.from_arrays([*open_at, pc.binary_join(listed, "\n")], names)
            open_at, parts = None, []
        if len(first):
            if after[-1]:
                bounds, first = first, first[:-1]
                at = int(bounds[-1])
                open_at, parts = [split.slice(at, 1), row.slice(at, 1)], [value.slice(at)]
            else:
                bounds = np.append(first, np.int32(len(value)))
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), value)
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [split.take(at), row.take(at), pc.binary_join(listed, "\n")], names
            )


def split_records(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """src_file, src_block, src_row and record: the text of each record, with its lines joined by
    line feeds. The position is that of its first line; records without text are left out;
    ``is_header`` marks the first one of each file.

    A cell in quotes that is never closed goes on to the end of its file.
    """
    lines = _lines(spark, files)
    # As many rows as splits, which Spark's planning on the driver lists already.
    starts = F.broadcast(written(split_starts(lines), "csv_split_starts"))
    row = F.col("src_row")
    # Lines are known by their split and number; both depend on how Spark splits the files.
    refused = F.raise_error(F.concat(F.lit("split otherwise when read again: "), "src_file"))
    as_before = F.when(row.between(F.col("low"), F.col("high")), True)
    placed = lines.join(starts, list(_SPLIT), "left").where(
        as_before.otherwise(refused.cast("boolean"))
    )
    is_body = F.coalesce(row >= F.col("body"), F.lit(False)) & F.coalesce(
        row < F.col("opens"), F.lit(True)
    )
    whole = (
        placed.where(is_body)
        .select("split", "src_row", "value", *_FLAGS)
        .mapInArrow(_whole_records, "split long, src_row long, record string")
        .join(starts.select("split", *_SPLIT, "header"), "split")
        .select(*_SPLIT, "src_row", "record", "header")
    )
    begun = F.when(row >= F.col("opens"), F.struct("src_block", F.col("opens").alias("src_row")))
    part = F.struct("src_block", "src_row", "value")
    over_ends = (
        placed.where(~is_body)
        .withColumn("begun", F.coalesce(begun, "goes_on"))
        .groupBy("src_file", "begun", "header")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "src_file", "begun.src_block", "begun.src_row",
            F.array_join("parts.value", "\n").alias("record"), "header",
        )
    )
    records = whole.unionByName(over_ends).where(F.trim("record") != "")
    return records.withColumn("is_header", row == F.col("header")).drop("header")
