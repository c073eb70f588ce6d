"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.workspace import written

#: Edges for each file of the tables of the steps: a few MB.
FILE_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn until each component is a star around its smallest
    node. Each step connects neighbours with the smallest of them; no task or driver sees a whole
    component. The tables of the steps have as many files as their edges need, not one for each
    shuffle partition: a few edges over many partitions would cost a task each, in every step.
    """
    edges = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a < b")
        .distinct(),
        "edges",
    )
    files = edges.count() // FILE_ROWS + 1
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = _smallest(both, files)
        if smallest.where("is_open").isEmpty():
            break
        large = _starred(both, smallest, F.col("b") > F.col("a"))
        large = written(large.coalesce(files), "edges")
        turned = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        small = _starred(turned, _smallest(turned, files), F.lit(True)).distinct()
        edges = written(small.coalesce(files), "edges")
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    rest = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return rest.unionByName(roots).coalesce(files)


def _smallest(near: DataFrame, files: int) -> DataFrame:
    """a, root: the smallest node among a and its neighbours; and, of edges that are all different,
    is_open: a is neither the smaller end of all its edges nor the larger end of a single one. Where
    no node is, another step would change nothing."""
    below = F.count_if(F.col("b") < F.col("a"))
    return written(
        near.groupBy("a")
        .agg(
            F.least(F.col("a"), F.min("b")).alias("root"),
            ((below > 1) | ((below > 0) & (F.max("b") > F.col("a")))).alias("is_open"),
        )
        .coalesce(files),
        "smallest",
    )


def _starred(near: DataFrame, smallest: DataFrame, moved: F.Column) -> DataFrame:
    """Each neighbour b of a that is ``moved``, and a itself, connected with the smallest node
    among a and its neighbours. An edge may come several times."""
    moves = near.join(smallest, "a").where(moved).select(F.col("root").alias("a"), "b")
    own = smallest.select(F.col("root").alias("a"), F.col("a").alias("b"))
    return moves.unionByName(own).where("a < b")
