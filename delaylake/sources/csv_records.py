"""Delimited text with a header row, every cell kept as text."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaylake.functions.messages import text_schema
from delaylake.sources.csv_split import GOES_ON, OPEN, split_records

POSITION = ("src_file", "src_block", "src_row")
_RAW, _CELLS = "_raw_record", "_cells"


def _cells_in(raw: Column) -> Column:
    """Number of cells in a record, commas inside quotes not counted."""
    bare = F.regexp_replace(raw, rf'(^|,){OPEN}(?:"|\z)', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1


def files_by_line_breaks(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """Files without and files with a line break inside quotes.

    The look is a splittable text scan; it returns one row per file, which is what
    Spark's own file listing on the driver holds already.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    goes_on = F.col("value").contains('"') & F.col("value").rlike(GOES_ON)
    found = lines.groupBy("file").agg(F.max(goes_on).alias("goes_on")).collect()
    files = {unquote(r["file"]): r["goes_on"] for r in found}
    return [f for f, on in files.items() if not on], [f for f, on in files.items() if on]


def as_named(path: str) -> str:
    """The path of one file, with what would be a pattern in it escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_csv_records(
    spark: SparkSession,
    path: str | list[str],
    line_breaks: bool | None = None,
    with_position: bool = False,
) -> DataFrame:
    """Records named by the header row.

    An empty cell is the empty string, a cell missing from a short record is NULL,
    surplus cells are dropped, and records without any text are skipped. A cell with text after
    its closing mark is plain text, marks included.

    Spark's reader can split a file among tasks only if no record spans lines, so by default
    (``line_breaks=None``) each file is looked at first, and those with line breaks in quotes
    are split by ``split_records``, which reads them four times more and shuffles few of their lines.
    Say True or False to save that look. Breaks in quotes become line feeds.

    ``with_position`` adds file, split and row number columns that give the order of
    the records in the source; materialize them (write the frame) before use.
    """
    if line_breaks is None:
        places = path if isinstance(path, str) else [as_named(f) for f in path]
        single, spanning = files_by_line_breaks(spark, places)
    else:
        paths = [path] if isinstance(path, str) else path
        single, spanning = ([], paths) if line_breaks else (paths, [])
    if not single and not spanning:
        raise ValueError(f"no text found in {path}")

    if line_breaks is None or not isinstance(path, str):
        single, spanning = ([as_named(f) for f in files] for files in (single, spanning))
    options = {"quote": '"', "escape": '"'}
    header = spark.read.options(**options, multiLine=bool(spanning))
    names = header.csv((single or spanning)[0], header=True).columns
    schema = text_schema(names).add(_RAW, T.StringType())

    def cells(rows: DataFrame, *position: str | Column) -> DataFrame:
        # Spark reads an unquoted empty cell as NULL; only a record with fewer cells than
        # the header (kept raw) really lacks some of them.
        counted = rows.withColumn(
            _CELLS, F.when(F.col(_RAW).isNull(), len(names)).otherwise(_cells_in(F.col(_RAW)))
        )
        found = [
            F.coalesce(F.col(f"`{name}`"), F.when(F.col(_CELLS) > i, "")).alias(name)
            for i, name in enumerate(names)
        ]
        return counted.select(*found, *(position if with_position else []))

    def read_single() -> DataFrame:
        rows = (
            spark.read.schema(schema)
            .options(
                **options,
                header=True,
                enforceSchema=False,
                columnNameOfCorruptRecord=_RAW,
                # Else a short record is only noticed if all columns are asked for.
                columnPruning=False,
            )
            .csv(single)
        )
        return cells(
            rows,
            F.col("_metadata.file_path").alias("src_file"),
            F.col("_metadata.file_block_start").alias("src_block"),
            F.monotonically_increasing_id().alias("src_row"),
        )

    def read_spanning() -> DataFrame:
        how = options | {"columnNameOfCorruptRecord": _RAW}
        expected = header.csv(spanning[0], header=False).first()
        fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
        parsed = F.from_csv("record", fields, how)
        as_expected = [parsed[n].eqNullSafe(F.lit(v)) for n, v in zip(names, expected)]
        refused = F.raise_error(F.concat(F.lit("another header in "), "src_file"))
        kept = F.when(~F.col("is_header"), True).when(
            ~reduce(Column.__and__, as_expected), refused.cast("boolean")
        )
        records = split_records(spark, spanning).where(kept)
        return cells(records.select(*POSITION, F.inline(F.array(parsed))), *POSITION)

    parts = [read() for f, read in ((single, read_single), (spanning, read_spanning)) if f]
    return reduce(DataFrame.unionByName, parts)


def source_row_count(records: DataFrame) -> DataFrame:
    """Number of records (not of lines: quoted line breaks and blank lines do not count)."""
    return records.agg(F.count(F.lit(1)).alias("n"))
