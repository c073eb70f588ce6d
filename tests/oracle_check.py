"""Compare queries with their SQL in DuckDB: python tests/oracle_check.py [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when both sides have the same columns and the same multiset of rows."""
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    ours = _multiset(df.columns, df.collect())
    theirs = _multiset(columns, found.fetchall())
    if ours == theirs:
        return ""
    extra, lacking = (list(d.items())[:3] for d in (ours - theirs, theirs - ours))
    return f"only in Spark {extra}, only in SQL {lacking}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    options = [a for a in sys.argv[1:] if a.startswith("-")]
    words = [a for a in sys.argv[1:] if not a.startswith("-")]
    sf_dir = words[0] if words else "/root/testdata/sf0.01"
    names = words[1:] or list(contract.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), contract.oracle_sql()
    for name in names:
        start = time.time()
        df = contract.queries()[name](spark, sf_dir)
        if name in sqls:
            result = differences(df, con, sqls[name]) or "equal"
            if "--types" in options:
                theirs = {c[0]: str(c[1]) for c in con.execute(sqls[name]).description}
                result += f" {[(c, t, theirs.get(c)) for c, t in df.dtypes]}"
        else:
            result = f"{df.count()} rows"
        print(f"{name:20s} {time.time() - start:6.2f}s {result}", flush=True)
