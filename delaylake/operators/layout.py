"""The fact table laid out for readers that group by the same keys again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lay_out(fact: DataFrame, name: str, path: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """The rows as the catalog's table ``name``, in ``buckets`` buckets by the keys, each file
    sorted by them; a table of that name is replaced.

    Rows with the same keys are in one bucket, so grouping by the keys, or by them and more
    columns, needs no exchange, nor does a join with a table of the same layout. The rows are
    rebalanced by the keys first: a bucket fills few files, and a large one is written by several
    tasks. It is read by one task, though: where a few keys have most rows, a summary of the plain
    table, which counts before it shuffles, is faster.

    NULL keys are keys like any other. Without rows the table is empty."""
    rebalanced = fact.hint("rebalance", buckets, *keys)
    rebalanced.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(
        *keys
    ).saveAsTable(name)
    return fact.sparkSession.table(name)
