"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    """For a local master without a setting; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    ``spark.checkpoint.dir`` decides. A temporary folder is used only on a local
    master; on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def scratch_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_dir(spark)}/delaylake/{spark.conf.get('spark.app.id')}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Frames that read them end with it, so
    call it when their results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: later reads see the same rows, also after
    executors are lost, and read no more columns and row groups than they need."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_parts(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows in range partitions by ``order``, numbered in that order by ``_part``, as a
    written table. A value of ``_part`` fills files of its own, so a filter on it skips
    the others. Columns of ``df`` that order rows fully keep the partitions even."""
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return written(parts, "range_parts")
