"""Packing documents into training sequences of fixed length.

Method: bounded-space online packing. Every partition reads its documents once and keeps a
fixed number of open windows. A document goes to the window that it fits best. If it fits
none, the fullest window is emitted, filled up with the front of the document when it still
lacks more than ``waste`` ids. The windows that are open at the end are leftovers; all
partitions' leftovers are laid end to end and cut into full windows, and the last of them
into powers of two.

Defined results: a null text is an empty one, whose only id is the end mark; a document
longer than a window is cut into full windows and a rest; documents with equal (or null) ids
are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm.byte_bpe import byte_bpe
from delaylake.llm.common import arrow_schema, map_batches, text_or_empty, to_batch
from delaylake.operators.ordering import running_before
from delaylake.workspace import written

WINDOW = 2048
OPEN_WINDOWS = 64
WASTE = 16
#: Fixed value: the id that ends a document.
END_ID = 1

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


class OpenWindows:
    """At most ``most`` windows of ``size`` ids, found by the room that they still have."""

    def __init__(self, size: int, most: int, waste: int):
        self.size, self.most, self.waste = size, most, waste
        self.by_room: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.made = 0

    def place(self, piece: tuple, length: int) -> Iterator[list]:
        """Put a piece (document, start, length) in; yields the windows that are emitted."""
        document, start, _ = piece
        while length >= self.size:
            yield [(document, start, self.size)]
            start, length = start + self.size, length - self.size
        while length:
            at = bisect_left(self.by_room, (length, -1))
            if at < len(self.by_room):
                room, window = self.by_room.pop(at)
            elif len(self.by_room) < self.most:
                room, window, self.made = self.size, self.made, self.made + 1
                self.pieces[window] = []
            else:
                room, window = self.by_room.pop(0)
                if room > self.waste:
                    self.pieces[window].append((document, start, room))
                    start, length = start + room, length - room
                yield self.pieces.pop(window)
                continue
            self.pieces[window].append((document, start, length))
            if room == length:
                yield self.pieces.pop(window)
            else:
                insort(self.by_room, (room - length, window))
            return

    def rest(self) -> Iterator[list]:
        """The open windows, the fullest first."""
        for _, window in self.by_room:
            yield self.pieces[window]


def pack(
    docs: DataFrame,
    vocabulary: str,
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document: where it was cut out and where it lies.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, if wanted.
    """
    schema = f"{PIECES}, ids binary, leftover boolean"
    arrow = arrow_schema(docs.sparkSession, schema)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary).encode
        windows = OpenWindows(size, open_windows, WASTE)
        first = TaskContext.get().partitionId() << 40
        emitted = 0
        rows: list[tuple] = []

        def add(pieces: list, leftover: bool) -> None:
            offset = 0
            for (doc_id, ids), start, length in pieces:
                part = ids[4 * start : 4 * (start + length)]
                total = len(ids) // 4
                rows.append(
                    (doc_id, start, length, zlib.crc32(part), total, first + emitted, offset,
                     part if with_ids or leftover else None, leftover)
                )
                offset += length

        def flush() -> pa.RecordBatch:
            columns = dict(zip(arrow.names, zip(*rows, strict=True), strict=True))
            rows.clear()
            return to_batch(columns, arrow)

        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for doc_id, text in zip(ids, texts, strict=True):
                document = (doc_id, encode(text) + end)
                length = len(document[1]) // 4
                for window in windows.place((document, 0, length), length):
                    add(window, leftover=False)
                    emitted += 1
                if len(rows) >= 2000:
                    yield flush()
        for window in windows.rest():
            add(window, leftover=True)
            emitted += 1
        if rows:
            yield flush()

    packed = written(
        docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema), "packed"
    )
    full = packed.where(~F.col("leftover")).drop("leftover")
    pieces = full.unionByName(_laid_end_to_end(packed.where("leftover"), size))
    return pieces if with_ids else pieces.drop("ids")


def _laid_end_to_end(leftovers: DataFrame, size: int) -> DataFrame:
    """Pieces one after the other, cut at every multiple of ``size``; the end is cut into
    powers of two, which need no padding."""
    order = ["sequence_id", "offset"]
    placed = written(running_before(leftovers, order, F.col("length"), "at"), "leftovers")
    total = placed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    edges = [total - total % size]
    for power in reversed(range(size.bit_length())):
        if (total % size) & (1 << power):
            edges.append(edges[-1] + (1 << power))

    def cut(batch: pa.RecordBatch):
        names = ("doc_id", "start", "length", "doc_tokens", "at", "ids")
        out = {f.split()[0]: [] for f in PIECES.split(", ")} | {"ids": []}
        for doc_id, start, length, tokens, at, ids in zip(
            *(batch.column(n).to_pylist() for n in names), strict=True
        ):
            done = 0
            while done < length:
                here = at + done
                if here < edges[0]:
                    left = here - here % size
                    right, sequence = left + size, here // size
                else:
                    i = next(i for i in range(1, len(edges)) if here < edges[i])
                    left, right, sequence = edges[i - 1], edges[i], edges[0] // size + i - 1
                n = min(right - here, length - done)
                part = ids[4 * done : 4 * (done + n)]
                row = (doc_id, start + done, n, zlib.crc32(part), tokens, -1 - sequence,
                       here - left, part)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                done += n
        yield out

    return map_batches(placed, cut, f"{PIECES}, ids binary")
