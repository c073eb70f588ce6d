"""Ranked lexical search, exact.

Method: accumulator-limited term-at-a-time. The documents lie in shards; a shard has, for each term
that is asked for, the places of the documents that hold it, and how often. An item's terms are
taken from the rarest on. A term opens an accumulator for every document of its list, as long
as a document without one can still get among the best: once the terms that are left cannot add up
to more than the kth best score so far, no more accumulators are opened, and the others are
updated to their exact ends. A task goes through its shards one after another and carries each
item's best documents along, so that the kth best score of the shards before limits the next.

Counts that scores depend on (documents, their lengths, the documents of each term) are taken over
the whole table first. Items are taken in blocks of a bounded number of terms; a block's terms go
along with the tasks, and its terms' lists are made by one pass over the documents.

Defined results: a null or empty text has no terms; a document without terms does not count; one
without an id counts, and is ranked after those of its score that have one; rows that repeat an
id are documents or items of their own, and equal ones are returned in any order; an item without
a known term has no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delaylake.llm.common import arrow_schema, text_or_empty, to_batch
from delaylake.workspace import written

K = 50
#: Documents and postings of a shard, and terms of a block of items (a longer item is a block of
#: its own): these bound a task's memory at any size of the tables.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 32_768, 1_000_000, 100_000

#: Constants of the weight of an occurrence.
SCALE, FULL, LENGTH_SHARE = 1_000_000_000, 100, 50

_SHARD = (
    "n_docs long, n_terms long, held binary, doc_ids binary, sizes binary, ends binary, "
    "docs binary, times binary"
)
_FOUND = "item long, doc_id long, score long"
_SEPARATORS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A to Z in lower case."""
    return text.encode().translate(_SEPARATORS).split()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' numbers with their terms, in blocks that come to the driver one at a time."""
    block, size = [], 0
    for row in items.select("item", text_or_empty().alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if block and size + len(terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["item"], terms))
        size += len(terms)
    if block:
        yield block


def _shards(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Inverted lists of the terms, in shards of documents."""
    arrow = arrow_schema(docs.sparkSession, _SHARD)
    # From 1 on: what is not asked for is None.
    places = {t: i for i, t in enumerate(terms, 1)}.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes, lengths = array("q"), array("q")
        term, times = array("i"), array("I")

        def close() -> pa.RecordBatch:
            terms_held = np.array(term, dtype=np.int32)
            doc = np.repeat(np.arange(len(ids), dtype="<u4"), np.array(lengths, dtype=np.int64))
            order = np.argsort(terms_held, kind="stable")
            ends = np.cumsum(np.bincount(terms_held, minlength=len(terms)))
            columns = {
                "n_docs": [len(ids)],
                "n_terms": [sum(sizes)],
                "held": [np.array([i is not None for i in ids], dtype=bool).tobytes()],
                "doc_ids": [np.array([i or 0 for i in ids], dtype="<i8").tobytes()],
                "sizes": [np.array(sizes, dtype="<i8").tobytes()],
                "ends": [ends.astype("<i8").tobytes()],
                "docs": [doc[order].tobytes()],
                "times": [np.array(times, dtype="<u4")[order].tobytes()],
            }
            ids.clear()
            for part in (sizes, lengths, term, times):
                del part[:]
            return to_batch(columns, arrow)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_terms = terms_of(text)
                if not all_terms:
                    continue
                found = Counter(filter(None, map(places, all_terms)))
                ids.append(doc_id)
                sizes.append(len(all_terms))
                lengths.append(len(found))
                term.extend(t - 1 for t in found)
                times.extend(found.values())
                if len(ids) == SHARD_DOCS or len(term) >= SHARD_POSTINGS:
                    yield close()
        if ids:
            yield close()

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return written(texts.mapInArrow(run, _SHARD), "search_shards")


def _documents_of(shards: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; no more rows than a block has terms reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for ends in batch.column(0).to_pylist():
                total += np.diff(np.frombuffer(ends, dtype="<i8"), prepend=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    counted = shards.select("ends").mapInArrow(run, "term long, n long")
    out = np.zeros(terms, dtype=np.int64)
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


class _Shard:
    """A shard's inverted lists, with what an occurrence adds to a score."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.held = np.frombuffer(row["held"], dtype=bool)
        self.ids = np.frombuffer(row["doc_ids"], dtype="<i8")
        self.docs = np.frombuffer(row["docs"], dtype="<u4")
        self.ends = np.concatenate([[0], np.frombuffer(row["ends"], dtype="<i8")])
        sizes = np.frombuffer(row["sizes"], dtype="<i8")
        room = FULL - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // n_terms
        times = np.frombuffer(row["times"], dtype="<u4").astype(np.int64)
        self.adds = (SCALE * times) // (1000 * times + 20 * room[self.docs])
        self.adds *= np.repeat(weights, np.diff(self.ends))
        self.scores = np.zeros(len(self.ids), dtype=np.int64)
        self.is_open = np.zeros(len(self.ids), dtype=bool)
        # The most that a term adds here.
        full = np.flatnonzero(np.diff(self.ends))
        self.most = np.zeros(len(weights), dtype=np.int64)
        if len(full):
            self.most[full] = np.maximum.reduceat(self.adds, self.ends[full])

    def best(self, terms: list[int], k: int, least: int) -> list[tuple[int, int]]:
        """Score and place of this shard's k best documents, those below ``least`` left out;
        ``terms`` from the rarest on."""
        scores, is_open = self.scores, self.is_open
        left = [*np.cumsum(self.most[terms][::-1])[::-1].tolist(), 0]
        open_to_all, opened = True, np.empty(0, dtype=np.int64)
        for i, term in enumerate(terms):
            a, b = self.ends[term], self.ends[term + 1]
            docs, adds = self.docs[a:b], self.adds[a:b]
            if not open_to_all:
                updated = is_open[docs]
                scores[docs[updated]] += adds[updated]
                continue
            new = docs[~is_open[docs]]
            is_open[new] = True
            opened = np.concatenate([opened, new])
            scores[docs] += adds
            kth = least
            # No score is above the bounds of the terms so far.
            if len(opened) >= k and left[0] - left[i + 1] > left[i + 1]:
                kth = max(kth, _kth(scores[opened], k))
            # A document met later on reaches the bound at most; with the kth score it would tie.
            open_to_all = left[i + 1] >= kth
        reached = scores[opened]
        bar = max(least, 1, _kth(reached, k) if len(opened) > k else 0)
        chosen = opened[reached >= bar]
        order = np.lexsort((self.ids[chosen], ~self.held[chosen], -scores[chosen]))[:k]
        found = [(int(scores[p]), p) for p in chosen[order].tolist()]
        scores[opened] = 0
        is_open[opened] = False
        return found


def _kth(values: np.ndarray, k: int) -> int:
    """The kth highest."""
    return int(np.partition(values, len(values) - k)[-k])


def _search(
    shards: DataFrame, block: list[tuple[int, list[int]]], weights: np.ndarray, totals, k: int
) -> DataFrame:
    """The k best documents of each item in every task's shards."""
    arrow = arrow_schema(shards.sparkSession, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A heap has the worst of the best at its top.
        best: dict[int, list] = {item: [] for item, _ in block}
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row, weights, *totals)
                for item, terms in block:
                    heap = best[item]
                    least = heap[0][0] if len(heap) == k else 0
                    for score, place in shard.best(terms, k, least):
                        held, doc_id = bool(shard.held[place]), int(shard.ids[place])
                        entry = (score, held, -doc_id)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [
            (item, -order if held else None, score)
            for item, heap in best.items()
            for score, held, order in heap
        ]
        if rows:
            yield to_batch(dict(zip(arrow.names, zip(*rows, strict=True), strict=True)), arrow)

    return shards.mapInArrow(run, _FOUND)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents with a score above 0 for each item."""
    spark: SparkSession = docs.sparkSession
    asked = written(
        items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items"
    )
    parts = []
    for block in _blocks(asked):
        terms = sorted({t for _, ts in block for t in ts})
        shards = _shards(docs, terms)
        totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not totals[0]:
            break
        many = _documents_of(shards, len(terms))
        weights = np.array(
            [math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * n + 1))) for n in many.tolist()],
            dtype=np.int64,
        )
        number, adds = {t: i for i, t in enumerate(terms)}, (many > 0) & (weights > 0)
        by_rarity = [
            # A term without a weight, or without a document, adds nothing.
            (item, sorted((i for i in map(number.get, ts) if adds[i]), key=lambda i: (many[i], i)))
            for item, ts in block
        ]
        found = _search(shards, by_rarity, weights, tuple(totals), k)
        parts.append(written(found, "found"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    down = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (
        reduce(DataFrame.unionByName, parts)
        .withColumn("rank", F.row_number().over(down))
        .where(F.col("rank") <= k)
    )
    names = asked.select("item", "item_id")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
