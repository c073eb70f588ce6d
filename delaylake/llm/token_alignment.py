"""Aligning the tokens of two tokenizers.

Method: intersection of cumulative ends. Both tokenizers cut the same bytes; a dictionary leads from
the byte where a token of one ends to its number, and is asked for the ends of the other in their
order. The ends that both have, sorted thereby, slice the two lists of ids into groups, and within a group every token of one side is linked to every
token of the other. How many documents hold a pair of ids linked is counted over all documents:
each block of documents counts its own, the blocks' counts are summed, and a block gets back
the counts of the pairs that it holds and of no others.

Defined results: null and empty texts, and those whose tokens do not give the text back on both
sides, have no tokens, zeros, and an empty string in place of the hash; strings of special tokens
are plain text; every row is a document, also one that repeats an id or has none; other columns
are ignored. A group of many tokens is not expanded: its different ids are linked, and the
links counted.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm.byte_bpe import ByteBpe, byte_of_char
from delaylake.llm.common import arrow_schema, text_or_empty, to_batch
from delaylake.workspace import written

#: Tokens of a block of documents (a longer document is a block of its own): it bounds a task's
#: memory at any size of the table.
BLOCK_TOKENS = 1_000_000
#: Links of a group from which on its different ids are linked in place of all of them.
MANY_LINKS = 4096
#: Texts that the faster of two libraries for the first vocabulary is not given: characters whose
#: class it may see otherwise, and runs of white space that its pattern goes back over.
CAREFUL = re.compile(r"[^\x00-\xff]|\s{200}")

_ALIGNED = (
    "block long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs binary, times binary"
)
_SCORED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


class Tokenizers:
    """Ids of both tokenizers, the bytes of each id, and its number as text."""

    def __init__(self, path_a: str, path_b: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.careful = ByteBpe(path_a)
        self.careful.library.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        to_byte = byte_of_char()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            # A special token is no plain text, so no id of it comes up.
            if all(c in to_byte for c in token):
                self.bytes_a[i] = bytes(to_byte[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (
            np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b)
        )
        ranks = {token: i for i, token in enumerate(self.bytes_a) if token}
        self.fast = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        # What follows an id: another of its side, the other side, the next group.
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.name = [f"{i}{after}".encode() for after in ",|;" for i in range(self.most)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        if CAREFUL.search(text):
            return np.frombuffer(self.careful.encode(text), dtype="<u4").astype(np.int64)
        return np.array(self.fast.encode_ordinary(text), dtype=np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both; None where they do not give the text back."""
        if not text:
            return None
        whole = b" " + text.encode()
        a, b = self.encode_a(" " + text), self.b.encode(text)
        # A byte-level vocabulary has all bytes, so that its ids can only lack some at an end.
        if self.length_a[a].sum() != len(whole) or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, np.array(b, dtype=np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each side lie before the end of each group."""
        ends_a, ends_b = self.length_a[a].cumsum().tolist(), self.length_b[b].cumsum().tolist()
        index_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
        met = np.fromiter(map(index_b.get, ends_a, repeat(0)), np.int64, len(ends_a))
        common = np.flatnonzero(met)
        return common + 1, met[common]

    def digest(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        """Of all groups, as text."""
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        after_a, after_b = np.zeros_like(a), np.zeros_like(b)
        after_a[to_a - 1], after_b[to_b - 1] = 1, 2
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = a + self.most * after_a
        order[np.arange(len(b)) + np.repeat(to_a, in_b)] = b + self.most * after_b
        named = b"".join(map(self.name.__getitem__, order.tolist()))
        return hashlib.sha256(named[:-1]).hexdigest()


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each worker process."""
    return Tokenizers(path_a, path_b)


def links(
    a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, size_b: int
) -> tuple[np.ndarray, np.ndarray]:
    """The different linked pairs, as one number each, and how often each is linked."""
    in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    large = np.flatnonzero(in_a * in_b > MANY_LINKS)
    found, times = [], []
    for g in large.tolist():
        ids_a, n_a = np.unique(a[to_a[g] - in_a[g] : to_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[to_b[g] - in_b[g] : to_b[g]], return_counts=True)
        found.append((ids_a[:, None] * size_b + ids_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
    group = np.repeat(np.arange(len(in_a)), in_a)
    # Each token on the left, once for every token on the right of its group.
    reach = in_b.copy()
    reach[large] = 0
    reach = reach[group]
    first = np.repeat((to_b - in_b)[group], reach)
    place = np.arange(len(first)) - np.repeat(np.cumsum(reach) - reach, reach)
    pairs, n = np.unique(np.repeat(a, reach) * size_b + b[first + place], return_counts=True)
    if not found:
        return pairs, n
    pairs, where = np.unique(np.concatenate([pairs, *found]), return_inverse=True)
    total = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(total, where, np.concatenate([n, *times]))
    return pairs, total


def _aligned(docs: DataFrame, path_a: str, path_b: str, size_b: int, kind: str) -> DataFrame:
    """A row for each document, and one for each block with the documents of each pair."""
    arrow = arrow_schema(docs.sparkSession, _ALIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = tokenizers(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[np.ndarray] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal block, tokens
            if held:
                pairs, n = np.unique(np.concatenate(held), return_counts=True)
                counted = (pairs.astype(kind).tobytes(), n.astype("<u4").tobytes())
                rows.append((block, False, *[None] * 6, *counted))
            columns = dict(zip(arrow.names, zip(*rows, strict=True), strict=True))
            rows.clear()
            held.clear()
            block, tokens = block + 1, 0
            return to_batch(columns, arrow)

        for batch in batches:
            ids, texts = batch.columns
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                ids_of_both = both.encode(text.as_py())
                if ids_of_both is None:
                    rows.append((block, True, doc_id, 0, 0, 0, 0, "", b"", b""))
                else:
                    a, b = ids_of_both
                    to_a, to_b = both.groups(a, b)
                    pairs, times = links(a, b, to_a, to_b, size_b)
                    held.append(pairs)
                    rows.append(
                        (block, True, doc_id, len(a), len(b), len(to_a), int(times.sum()),
                         both.digest(a, b, to_a, to_b), pairs.astype(kind).tobytes(),
                         times.astype("<i8").tobytes() if times.max() >> 32
                         else times.astype("<u4").tobytes())
                    )
                    tokens += len(a)
                if tokens >= BLOCK_TOKENS or len(rows) >= BLOCK_TOKENS // 8:
                    yield close()
        if rows:
            yield close()

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return written(texts.mapInArrow(run, _ALIGNED), "aligned")


def _held(aligned: DataFrame, size_b: int, kind: str) -> DataFrame:
    """block, a, b, n: the documents of each block that hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.divmod(np.frombuffer(pairs, dtype=kind).astype(np.int64), size_b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), block)),
                        pa.array(a.astype(np.int32)),
                        pa.array(b.astype(np.int32)),
                        pa.array(np.frombuffer(n, dtype="<u4").astype(np.int64)),
                    ],
                    ["block", "a", "b", "n"],
                )

    blocks = aligned.where("not is_doc").select("block", "pairs", "times")
    return blocks.mapInArrow(run, "block long, a int, b int, n long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    size_b = len(tokenizers(path_a, path_b).bytes_b)
    kind = "<u4" if len(tokenizers(path_a, path_b).bytes_a) * size_b < 1 << 32 else "<i8"
    aligned = _aligned(docs, path_a, path_b, size_b, kind)
    held = _held(aligned, size_b, kind)
    totals = written(held.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    highest = totals.groupBy("a").agg(F.max("count").alias("highest"))
    known = totals.join(highest, "a").withColumn("best", F.col("count") == F.col("highest"))
    asked = held.join(known, ["a", "b"]).select("block", "a", "b", "count", "best")
    scored = arrow_schema(docs.sparkSession, _SCORED)

    def score(rows: pa.Table, counts: pa.Table) -> pa.Table:
        code = counts["a"].to_numpy().astype(np.int64) * size_b + counts["b"].to_numpy()
        order = np.argsort(code)
        code, count = code[order], counts["count"].to_numpy()[order]
        best = counts["best"].to_numpy()[order].astype(bool)
        n_best, count_sum = [], []
        for pairs, times in zip(rows["pairs"].to_pylist(), rows["times"].to_pylist(), strict=True):
            pairs = np.frombuffer(pairs, dtype=kind)
            times = np.frombuffer(times, dtype="<u4" if len(times) == 4 * len(pairs) else "<i8")
            at, times = np.searchsorted(code, pairs), times.astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.Table.from_arrays(
            [found[n] if n in found else rows[n].combine_chunks() for n in scored.names], schema=scored
        )

    return (
        aligned.where("is_doc").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, _SCORED)
    )
