"""What was taken from the source, run by run.

A generation is what one ingest publishes. Its manifest, written when its records are staged
and before any of them is published, names the source's files (with length and time) or the
digest of a frame, the number of slices and of rows. A second record marks it as finished.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.config import MESSAGE_CODEC, LakeConfig
from delaylake.operators import slicing
from delaylake.sources.csv_records import POSITION, read_csv_records

FILES = "path string, length bigint, modificationTime timestamp"


@dataclass(frozen=True)
class Generation:
    number: int
    slices: int
    rows: int
    digest: str | None
    finished: bool


def folder(path: str, number: int) -> str:
    return f"{path}/generation={number}"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _all(spark: SparkSession, cfg: LakeConfig) -> list[Generation]:
    """One row for each run that found something new."""
    begun = _table(spark, cfg.path("manifest/begun"))
    if begun is None:
        return []
    ended = _table(spark, cfg.path("manifest/finished"))
    done = set() if ended is None else {r["generation"] for r in ended.collect()}
    rows = begun.orderBy("generation").collect()
    return [
        Generation(r["generation"], r["slices"], r["rows"], r["digest"], r["generation"] in done)
        for r in rows
    ]


def last(spark: SparkSession, cfg: LakeConfig) -> Generation | None:
    return (_all(spark, cfg) or [None])[-1]


def rows_published(spark: SparkSession, cfg: LakeConfig) -> int | None:
    """Rows of all finished generations, or None while one is unfinished or there is none."""
    found = _all(spark, cfg)
    return sum(g.rows for g in found) if found and all(g.finished for g in found) else None


def staged(spark: SparkSession, cfg: LakeConfig, number: int) -> DataFrame:
    """The generation's records with positions, which stay the same on every read."""
    table = spark.read.parquet(folder(cfg.records, number))
    return table if set(POSITION) <= set(table.columns) else slicing.with_file_position(table)


def begin(
    spark: SparkSession, cfg: LakeConfig, before: Generation | None, records: DataFrame | None
) -> Generation | None:
    """Stage what is new in the source and write its manifest; None if nothing is.

    A CSV source keeps the order of its files, and a file that has changed counts as new; a
    frame is taken whole, in the order in which it is written here, if its rows differ from
    those of the generation before.
    """
    number = before.number + 1 if before else 1
    path, digest = folder(cfg.records, number), None
    if records is None:
        new = _new_files(spark, cfg)
        names = [r["path"] for r in new.select("path").collect()]
        if not names:
            return None
        source = cfg.source_csv if number == 1 else names
        read_csv_records(
            spark, source, line_breaks=cfg.line_breaks, with_position=True
        ).write.mode("overwrite").parquet(path, compression=MESSAGE_CODEC)
        new.write.mode("overwrite").parquet(folder(cfg.path("manifest/files"), number))
    else:
        records.write.mode("overwrite").parquet(path, compression=MESSAGE_CODEC)
        digest = _digest(spark.read.parquet(path))
        if before and digest == before.digest:
            return None
    rows = spark.read.parquet(path).count()
    made = Generation(number, cfg.slices, rows, digest, False)
    spark.range(1).select(
        F.lit(cfg.slices).alias("slices"),
        F.lit(rows).cast("bigint").alias("rows"),
        F.lit(digest).cast("string").alias("digest"),
    ).write.mode("overwrite").parquet(folder(cfg.path("manifest/begun"), number))
    return made


def finish(spark: SparkSession, cfg: LakeConfig, generation: Generation) -> None:
    spark.range(1).write.mode("overwrite").parquet(
        folder(cfg.path("manifest/finished"), generation.number)
    )


def _new_files(spark: SparkSession, cfg: LakeConfig) -> DataFrame:
    """Path, length and time of the source's files that no generation has; not their content."""
    there = (
        spark.read.format("binaryFile")
        .load(cfg.source_csv)
        .select("path", "length", "modificationTime")
    )
    known = _table(spark, cfg.path("manifest/files"))
    if known is None:
        return there
    same = ["path", "length", "modificationTime"]
    return there.join(known.select(*same), same, "left_anti")


def _digest(table: DataFrame) -> str:
    """Number of rows and the sum of their hashes: the same in any order."""
    found = table.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return f"{found[0]} {found[1]}"
