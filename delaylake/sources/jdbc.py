"""Loading the fact table into a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame

from delaylake.config import JdbcTarget

# Fixed values
TEXT_WIDTHS = {
    "origin": "VARCHAR(3)",
    "dest": "VARCHAR(3)",
    "airline": "VARCHAR(10)",
    "distance_bucket": "VARCHAR(6)",
    "delay_bucket": "VARCHAR(7)",
}


def connection_options(target: JdbcTarget) -> dict[str, str]:
    options = {
        "url": target.url,
        "user": target.user,
        "password": target.password,
        "driver": target.driver,
    }
    return {name: value for name, value in options.items() if value is not None}


def write_options(target: JdbcTarget, columns: list[str]) -> dict[str, str]:
    """Batch size, a bound on parallel connections, and column widths for a new table."""
    widths = ", ".join(f"{c} {TEXT_WIDTHS[c]}" for c in columns if c in TEXT_WIDTHS)
    return {
        "dbtable": target.table,
        "batchsize": str(target.batch_size),
        "numPartitions": str(target.max_connections),
        "truncate": "true",
        **({"createTableColumnTypes": widths} if widths else {}),
    }


def loaded_rows(spark, target: JdbcTarget) -> int:
    query = f"select count(*) as n from {target.table}"
    reader = spark.read.format("jdbc").options(**connection_options(target))
    return int(reader.option("query", query).load().first()["n"])


def load_fact(fact: DataFrame, target: JdbcTarget, append: bool = False) -> int:
    """Write the fact rows and return the number of rows then in the table.

    By default the table is emptied first (its definition and grants stay), so loading
    twice gives the same rows as loading once. Each task commits on its own, and a task
    that is run again after its commit would leave rows twice; the count in the database
    is therefore compared with the frame, and a difference raises, to be loaded again.

    ``append=True`` adds to the rows there, and is not safe to repeat.
    """
    spark = fact.sparkSession
    before = loaded_rows(spark, target) if append else 0
    writer = fact.write.format("jdbc").options(**connection_options(target))
    writer = writer.options(**write_options(target, fact.columns))
    writer.mode("append" if append else "overwrite").save()
    expected, found = before + fact.count(), loaded_rows(spark, target)
    if found != expected:
        raise RuntimeError(f"{target.table} holds {found} rows instead of {expected}: load again")
    return found
