"""Exact search for the highest inner products.

Method: distributed histogram selection. Queries and candidates are laid out in blocks; every
pair of a query block and a candidate part is scored, whole, by one matrix product. Each round
makes a histogram of the scores inside each query's present range, and the sum of the parts'
histograms tells which bin holds the query's kth highest score; the next round refines that bin.
When the bins are one wide, the kth score is known; the scores at or above it are selected, and
ties go to the smaller id. A part reports its bins from the top only until they hold k scores,
and at most k candidates: what lies below cannot count, so its output does not grow with it.

Defined results: vectors that are null or hold null or non-finite components take no part; a
vector is compared with those of its own length only, and the empty one with no other; a
component is floor(scale * x) in whole numbers, and scores beyond 64 bits stop at 2^63 - 1
or its negative; rows that repeat an id are candidates of their own, and a query's own id
is none; null ids take no part; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.llm.common import arrow_schema, to_batch
from delaylake.workspace import written

SCALE = 256
K = 5
BINS = 1024
#: Vectors of a query block and of a candidate part, and how many of each meet in one task:
#: these bound a task's memory at any size of the table.
BLOCK, PART = 256, 8192
BLOCKS, PARTS = 128, 8
#: Scores stop here; one below the smallest stands for no score.
MOST = np.iinfo(np.int64).max


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, norm and the vector as whole numbers (doubles) of those that take part."""
    wide = F.col("embedding").cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(wide, lambda x: _floor(x * scale))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return (
        vectors.where(F.col("vec_id").isNotNull() & wide.isNotNull() & (F.size(wide) > 0))
        .where(~bad)
        .select("vec_id", ints.alias("v"), F.size(wide).alias("dim"))
        .withColumn("norm", norm)
    )


def _floor(x):
    # floor() gives a bigint, which ends at 2^63; doubles beyond 2^53 are whole already.
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows of up to ``rows`` vectors of one length: a number, the ids, and the vectors in one
    binary."""
    schema = f"dim int, {name}_ids binary, {name}_v binary"
    arrow = arrow_schema(vectors.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}

        def close(dim: int) -> pa.RecordBatch:
            ids, parts = open_.pop(dim)
            columns = {
                "dim": [dim],
                f"{name}_ids": [np.array(ids, dtype="<i8").tobytes()],
                f"{name}_v": [np.concatenate(parts).astype("<f8").tobytes()],
            }
            return to_batch(columns, arrow)

        for batch in batches:
            for vec_id, v in zip(
                batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False),
                strict=True,
            ):
                ids, parts = open_.setdefault(len(v), ([], []))
                ids.append(vec_id)
                parts.append(v)
                if len(ids) == rows:
                    yield close(len(v))
        for dim in list(open_):
            yield close(dim)

    blocks = vectors.select("vec_id", "v").mapInArrow(run, schema)
    return written(blocks.withColumn(name, F.monotonically_increasing_id()), f"blocks_{name}")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of rows, as 64-bit numbers."""
    bound = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if bound < float(1 << 53):
        return (q @ c.T).astype(np.int64)
    exact = _python_ints(q) @ _python_ints(c).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _python_ints(m: np.ndarray) -> np.ndarray:
    out = np.empty(m.shape, dtype=object)
    out[...] = [[int(x) for x in row] for row in m]
    return out


def _ids_and_rows(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_ids"], dtype="<i8")
    return ids, np.frombuffer(row[f"{name}_v"], dtype="<f8").reshape(-1, row["dim"])


def _scored(queries: pa.Table, candidates: pa.Table) -> Iterator[tuple]:
    """Each query block with the candidates of each part of its length, and all their scores; a
    query has no score with its own id."""
    for i in range(queries.num_rows):
        block = queries.slice(i, 1).to_pylist()[0]
        q_ids, q = _ids_and_rows(block, "q")
        for j in range(candidates.num_rows):
            part = candidates.slice(j, 1).to_pylist()[0]
            if part["dim"] != block["dim"]:
                continue
            c_ids, c = _ids_and_rows(part, "c")
            scores = _scores(q, c)
            own = np.isin(q_ids, c_ids)
            scores[own] = np.where(q_ids[own][:, None] == c_ids, -MOST - 1, scores[own])
            yield block, q_ids, c_ids, scores


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, bins: int = BINS
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query."""
    ints = written(whole_numbers(vectors, scale), "vectors")
    candidates = _blocks(ints, PART, "c")
    queries = _blocks(ints.where(is_query), BLOCK, "q")
    parts = -(-candidates.count() // PARTS) or 1
    blocks = -(-queries.count() // BLOCKS) or 1
    # A grid: each group of query blocks meets each group of parts in one cell.
    def numbered(name: str, most: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(most).cast("long"))

    def every(most: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")))

    left = queries.withColumns({"group": numbered("q", blocks), "cell": every(parts)})
    right = candidates.withColumns({"cell": numbered("c", parts), "group": every(blocks)})

    def met(ranges: DataFrame | None, work, schema: str) -> DataFrame:
        """``work`` of every pair; ``starts`` has where each query's present range starts."""
        starts = F.lit(None).cast("array<bigint>")
        sides = left.withColumn("starts", starts) if ranges is None else left.join(ranges, "q")
        arrow = arrow_schema(vectors.sparkSession, schema)

        def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
            out = [to_batch(work(*x), arrow) for x in _scored(queries, candidates)]
            return pa.Table.from_batches(out, schema=arrow)

        by = ("group", "cell")
        return sides.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)

    # |score| <= |q| |c|, so no query's range is wider than that.
    largest = ints.agg(F.coalesce(F.max("norm"), F.lit(0.0))).first()[0]
    bound = int(min(largest * largest + 2, float(MOST)))
    lowest, width = -min(bound, MOST), 1
    while lowest + width * bins <= bound:
        width *= bins
    ranges = None
    while width:
        ranges = _refined(met, ranges, lowest, width, k)
        width //= bins

    def select(block: dict, q_ids, c_ids, scores) -> dict:
        out: dict[str, list] = {"q": [], "i": [], "query_id": [], "vec_id": [], "score": []}
        least = np.array(block["starts"][: len(q_ids)], dtype=np.int64)
        rows, columns = np.nonzero((scores >= least[:, None]) & (scores >= -MOST))
        ends = np.searchsorted(rows, np.arange(len(q_ids) + 1))
        for i, query in enumerate(q_ids.tolist()):
            at = columns[ends[i] : ends[i + 1]]
            if len(at) > k:
                # ~score orders like -score, without its overflow.
                at = at[np.lexsort((c_ids[at], ~scores[i][at]))][:k]
            out["vec_id"] += c_ids[at].tolist()
            out["score"] += scores[i][at].tolist()
            for name, value in (("q", block["q"]), ("i", i), ("query_id", query)):
                out[name] += [value] * len(at)
        return out

    found = met(ranges, select, "q long, i int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _refined(met, ranges: DataFrame | None, lowest: int, width: int, k: int) -> DataFrame:
    """Where the bin of ``width`` with the kth score starts, for the queries of each block."""

    def count(block: dict, q_ids, c_ids, scores) -> dict:
        least = (block["starts"] or [lowest] * len(q_ids))[: len(q_ids)]
        best = scores
        if best.shape[1] > k:
            best = np.partition(scores, best.shape[1] - k, axis=1)[:, -k:]
        out: dict[str, list] = {"q": [], "i": [], "start": [], "n": []}
        for i, start in enumerate(least):
            bins, n = np.unique(
                [(s - start) // width for s in best[i].tolist() if s >= max(start, -MOST)],
                return_counts=True,
            )
            out["q"] += [block["q"]] * len(n)
            out["i"] += [i] * len(n)
            out["start"] += [start + int(b) * width for b in bins]
            out["n"] += n.tolist()
        return out

    counts = (
        met(ranges, count, "q long, i int, start long, n long")
        .groupBy("q", "i", "start")
        .agg(F.sum("n").alias("n"))
    )
    down = Window.partitionBy("q", "i").orderBy(F.desc("start"))
    ends = (
        counts.withColumn("above", F.sum("n").over(down) - F.col("n"))
        .where(F.col("above") < k)
        .groupBy("q", "i")
        .agg(F.min("start").alias("start"))
    )
    # Queries without a candidate have no row; their place is kept with the lowest start.
    started = ends.groupBy("q").agg(
        F.map_from_entries(F.collect_list(F.struct("i", "start"))).alias("by_place")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK - 1)),
        lambda i: F.coalesce(F.try_element_at("by_place", i), F.lit(lowest).cast("long")),
    )
    return written(started.select("q", every.alias("starts")), "ranges")
