"""Removing the bytes of long strings that an earlier document has too.

Method: suffix sorting by induction (``induced_sort``) of shards of the corpus. All 50-byte windows
are judged, in runs that share an anchor (``byte_runs``), since equal windows have equal anchors.
Three passes over blocks of documents:

1. Every block sends its distinct runs (hashes of anchor and content, smallest document) to the
   shard of the anchor. A shard knows the smallest document of each content, and which anchors
   stand in different contents; it tells the blocks.
2. Blocks send the bytes of the runs whose anchor stands in different contents, from the smallest
   document of each, in two halves: windows with at least SIDE bytes before the anchor, by those
   bytes, and the others by the bytes after it. So also a passage of a third of all documents is
   spread over shards by what surrounds it. A shard sorts the suffixes of all it got, and windows
   that share 50 bytes with their neighbour in that order are equal; their smallest document is
   told to the blocks of the others.
3. Blocks remove the windows for which a smaller document is known.

What a document shares whole runs of is settled by hashes (40 bits of the anchor with 56 of the
content); what it shares in part, byte by byte. Shuffled are compressed columns of numbers: rows
per block and shard, not per window.

Defined results: a null text is an empty one; texts of under 50 bytes stay; documents with equal
ids are not smaller than one another, and a null id is larger than any; repeated rows stay rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm.byte_runs import GRAM, WINDOW, content_hashes, find_runs
from delaylake.llm.common import arrow_schema, text_or_empty, to_batch
from delaylake.llm.induced_sort import MEMORY, common_prefix_at_least, sort_suffixes
from delaylake.llm.word_hashes import U64, chunks, mix
from delaylake.workspace import written

BLOCK_BYTES = 4 << 20
#: Bytes of text for each shard.
SHARD_BYTES = 16 << 20
#: Bytes on one side of the anchor that every window has on this or on the other side.
SIDE = (WINDOW - GRAM) // 2
CONTENT_BITS = U64((1 << 56) - 1)
NO_ID = np.iinfo(np.int64).max

BLOCKS = "block long, ids array<long>, n_bytes long, at binary, data binary"
PARTS = "shard long, block long, data binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the bytes of equal weight together, in zstandard."""
    out = [len(columns).to_bytes(1, "little")]
    for x in columns:
        x = x.astype("<u8")
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        data = pa.compress(planes, "zstd", asbytes=True)
        out.append(b"".join(n.to_bytes(8, "little") for n in (len(x), width, len(data))) + data)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        n, width, size = (int.from_bytes(data[at + i : at + i + 8], "little") for i in (0, 8, 16))
        at += 24
        planes = pa.decompress(data[at : at + size], n * width, "zstd", asbytes=True)
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += size
    return out


def in_order(x: np.ndarray) -> np.ndarray:
    """Sorted numbers as steps."""
    return np.diff(x, prepend=x[:1] * 0)


def to_blocks(docs: DataFrame) -> DataFrame:
    arrow = arrow_schema(docs.sparkSession, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            data, lengths = np.concatenate(parts), np.concatenate(sizes)
            return to_batch(
                {
                    "block": [block],
                    "ids": [ids],
                    "n_bytes": [len(data)],
                    "at": [packed(lengths)],
                    "data": [pa.compress(data.tobytes(), "zstd", asbytes=True)],
                },
                arrow,
            )

        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                parts.append(data)
                sizes.append(np.diff(at))
                ids += batch.column(0).slice(first, len(at) - 1).to_pylist()
                if sum(map(len, parts)) >= BLOCK_BYTES:
                    yield flush()
                    ids, parts, sizes, block = [], [], [], block + 1
        if ids:
            yield flush()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, BLOCKS)


class Block:
    """The runs of a block, and its distinct ones in order of shard, anchor and content."""

    def __init__(self, row: dict, shards: int):
        self.block, self.ids = row["block"], row["ids"]
        data = pa.decompress(row["data"], row["n_bytes"], "zstd", asbytes=True)
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.at = np.append(0, np.cumsum(unpacked(row["at"])[0])).astype(np.int64)
        self.doc = np.array([NO_ID if i is None else i for i in self.ids], dtype=np.int64)
        self.start, self.size, anchor, self.anchor_at = find_runs(self.data, self.at)
        content = content_hashes(self.data, self.start, self.size + WINDOW - 1) & CONTENT_BITS
        shard = (mix(anchor) % U64(shards)).astype(np.int64)
        self.run_doc = self.doc[np.searchsorted(self.at, self.start, side="right") - 1]
        order = np.lexsort((self.run_doc, content, anchor, shard))
        anchor, content, shard = anchor[order], content[order], shard[order]
        begins = np.ones(len(order), dtype=bool)
        begins[1:] = (np.diff(anchor) != 0) | (np.diff(content) != 0)
        firsts = np.flatnonzero(begins)
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(begins) - 1
        #: Of each distinct run: an occurrence in its smallest document.
        self.example = order[firsts]
        self.anchor, self.content = anchor[firsts], content[firsts]
        self.least = self.run_doc[self.example]
        self.cuts = np.searchsorted(shard[firsts], np.arange(shards + 1))

    def told(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Takes in what the shards say: the smallest documents, and the entries to be sent."""
        asked = [np.zeros(0, dtype=np.int64)]
        for shard, data in answers:
            first = self.cuts[shard]
            changed, doc, wanted = unpacked(data)
            self.least[first + np.cumsum(changed).astype(np.int64)] = doc.astype(np.int64)
            asked.append(first + np.cumsum(wanted).astype(np.int64))
        return np.concatenate(asked)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def shard_rows(shards: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list]]:
    """Each shard's part of the columns; the shards are sorted."""
    firsts = np.flatnonzero(np.diff(shards, prepend=-1))
    for i, j in zip(firsts, np.append(firsts, len(shards))[1:], strict=True):
        yield int(shards[i]), [c[i:j] for c in columns]


def send_runs(blocks: DataFrame, shards: int) -> DataFrame:
    arrow = arrow_schema(blocks.sparkSession, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = Block(row, shards)
                full = np.flatnonzero(np.diff(own.cuts))
                base = own.least.min(initial=NO_ID)
                data = [
                    packed(in_order(own.anchor[i:j]), own.content[i:j],
                           np.array([base]), own.least[i:j] - base)
                    for i, j in ((own.cuts[s], own.cuts[s + 1]) for s in full)
                ]
                yield to_batch(
                    {"shard": full, "block": [own.block] * len(full), "data": data}, arrow
                )

    return blocks.mapInArrow(run, PARTS)


def judge_runs(sent: DataFrame) -> DataFrame:
    """Each block's answer: entries whose content has a smaller document elsewhere, and entries
    that are the content's smallest and whose anchor has other contents, of other documents."""
    arrow = arrow_schema(sent.sparkSession, PARTS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("data").to_pylist()]
        blocks = table.column("block").to_pylist()
        sizes = [len(p[1]) for p in parts]
        anchor = np.concatenate([np.cumsum(p[0]) for p in parts])
        content = np.concatenate([p[1] for p in parts])
        doc = np.concatenate([(p[2] + p[3]).astype(np.int64) for p in parts])
        del parts
        order = np.lexsort((doc, content, anchor))
        a, d = anchor[order], doc[order]
        new_anchor = np.ones(len(order), dtype=bool)
        new_anchor[1:] = np.diff(a) != 0
        new = new_anchor.copy()
        new[1:] |= np.diff(content[order]) != 0
        group = np.cumsum(new) - 1
        least = d[new]
        anchor_of = np.cumsum(new_anchor[new]) - 1
        firsts = np.flatnonzero(new_anchor[new])
        low, high = (f.reduceat(least, firsts) for f in (np.minimum, np.maximum))
        parted = (low < high)[anchor_of]
        least_doc = np.empty(len(order), dtype=np.int64)
        least_doc[order] = least[group]
        border = np.empty(len(order), dtype=bool)
        border[order] = parted[group]
        out: dict[str, list] = {"shard": [], "block": [], "data": []}
        at = 0
        for block, size in zip(blocks, sizes, strict=True):
            own = slice(at, at + size)
            changed = np.flatnonzero(least_doc[own] < doc[own])
            wanted = np.flatnonzero(border[own] & (least_doc[own] == doc[own]))
            if len(changed) or len(wanted):
                out["shard"].append(key[0].as_py())
                out["block"].append(block)
                out["data"].append(
                    packed(in_order(changed), least_doc[own][changed], in_order(wanted))
                )
            at += size
        return pa.Table.from_batches([to_batch(out, arrow)], schema=arrow)

    return sent.groupBy("shard").applyInArrow(run, PARTS)


def send_bytes(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """The halves of the entries that are asked for: key, document, entry, first window, number
    of windows, and the bytes."""
    arrow = arrow_schema(blocks.sparkSession, PARTS)

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "block": [], "data": []}
        for row in _rows(table):
            own = Block(row, shards)
            asked = own.told([(x["shard"], x["data"]) for x in _rows(told)])
            example = own.example[asked]
            start, end, middle = (
                own.start[example], own.start[example] + own.size[example], own.anchor_at[example]
            )
            # Windows from start to split have SIDE bytes before the anchor.
            split = np.clip(middle - SIDE + 1, start, end)
            halves = []
            for first, last, side in ((start, split, -SIDE), (split, end, GRAM)):
                some = np.flatnonzero(first < last)
                near = middle[some] + side
                order = np.argsort(near, kind="stable")
                around = np.empty(len(some), dtype=np.uint64)
                around[order] = content_hashes(
                    own.data, near[order], np.full(len(some), SIDE, dtype=np.int64)
                )
                key = mix(own.anchor[asked[some]] ^ around ^ U64(side & 1023))
                halves.append(
                    (key, asked[some], first[some] - start[some], last[some] - first[some],
                     first[some])
                )
            key, entry, offset, windows, first = (
                np.concatenate(x) for x in zip(*halves, strict=True)
            )
            shard = (mix(key) % U64(shards)).astype(np.int64)
            order = np.lexsort((key, shard))
            columns = (x[order] for x in (shard, key, entry, offset, windows, first))
            for name, (key, entry, offset, windows, first) in shard_rows(*columns):
                lengths = windows + WINDOW - 1
                text = own.data[ranges(first, lengths)]
                out["shard"].append(name)
                out["block"].append(own.block)
                out["data"].append(
                    packed(in_order(key), own.least[entry], entry, offset, windows, text)
                )
        return pa.Table.from_batches([to_batch(out, arrow)], schema=arrow)

    return (
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, PARTS)
    )


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all stretches, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def equal_windows(
    texts: np.ndarray, windows: np.ndarray, docs: np.ndarray, memory: int = MEMORY
) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of bytes, each ``windows`` + 49 long and of a document: the number of the
    stretch and of the window in it, of all windows that a smaller document has as well."""
    lengths = windows + WINDOW - 1
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    # 0 ends the text, 1 a stretch.
    whole = np.ones(int(ends[-1]) + 1, dtype=np.int16)
    whole[-1] = 0
    whole[ranges(starts, lengths)] = texts.astype(np.int16) + 2
    stretch = np.repeat(np.arange(len(windows)), windows)
    window = ranges(np.zeros(len(windows), dtype=np.int64), windows)
    number = np.full(len(whole), -1, dtype=np.int64)
    number[starts[stretch] + window] = np.arange(len(stretch))
    runs = [r[number[r] >= 0] for r in sort_suffixes(whole, 258, memory)]
    order = np.concatenate(runs)
    group = np.cumsum(~common_prefix_at_least(whole, order, WINDOW)) - 1
    doc = docs[stretch[number[order]]]
    least = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1)))
    later = number[order][doc > least[group]]
    return stretch[later], window[later]


def judge_bytes(sent: DataFrame, memory: int = MEMORY) -> DataFrame:
    arrow = arrow_schema(sent.sparkSession, PARTS)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("data").to_pylist()]
        blocks = table.column("block").to_pylist()
        near = np.concatenate([np.cumsum(p[0]) for p in parts])
        doc, entry, offset, windows = (
            np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, 5)
        )
        block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        text = np.concatenate([p[5] for p in parts]).astype(np.uint8)
        del parts
        _, alike, counts = np.unique(near, return_inverse=True, return_counts=True)
        some = counts[alike] > 1
        out: dict[str, list] = {"shard": [], "block": [], "data": []}
        if some.any():
            text = text[np.repeat(some, windows + WINDOW - 1)]
            doc, entry, offset, windows, block = (
                x[some] for x in (doc, entry, offset, windows, block)
            )
            i, window = equal_windows(text, windows, doc, memory)
            order = np.lexsort((window, entry[i], block[i]))
            i, window = i[order], window[order]
            for b, (i, window) in shard_rows(block[i], i, window):
                out["shard"].append(key[0].as_py())
                out["block"].append(blocks[b])
                out["data"].append(packed(in_order(entry[i]), offset[i] + window))
        return pa.Table.from_batches([to_batch(out, arrow)], schema=arrow)

    return sent.groupBy("shard").applyInArrow(run, PARTS)


def remove(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """The documents without the windows that a smaller one has. ``answers`` has both kinds."""
    arrow = arrow_schema(blocks.sparkSession, RESULT)

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in _rows(table):
            own = Block(row, shards)
            answers = list(_rows(told))
            own.told([(x["shard"], x["data"]) for x in answers if x["whole"]])
            edge = np.zeros(len(own.data) + 1, dtype=np.int32)
            least = own.least[own.entry]
            gone = own.run_doc > least
            np.add.at(edge, own.start[gone], 1)
            np.add.at(edge, own.start[gone] + own.size[gone] + WINDOW - 1, -1)
            by_entry = np.argsort(own.entry, kind="stable")
            from_ = np.searchsorted(own.entry[by_entry], np.arange(len(own.example) + 1))
            for x in answers:
                if x["whole"]:
                    continue
                entry, window = unpacked(x["data"])
                entry, window = np.cumsum(entry).astype(np.int64), window.astype(np.int64)
                times = from_[entry + 1] - from_[entry]
                place = by_entry[ranges(from_[entry], times)]
                window = np.repeat(window, times)
                mine = own.run_doc[place] == least[place]
                at = own.start[place[mine]] + window[mine]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            firsts = own.at[:-1][own.at[:-1] < own.at[1:]]
            begins[firsts] = covered[firsts]
            removed, spans = (
                np.diff(np.append(0, np.cumsum(x, dtype=np.int64))[own.at])
                for x in (covered, begins)
            )
            kept = own.data[~covered]
            ends = np.cumsum(np.diff(own.at) - removed)
            for first in range(0, len(own.ids), 1000):
                some = slice(first, first + 1000)
                out.append(
                    to_batch(
                        {
                            "doc_id": own.ids[some],
                            "n_bytes": np.diff(own.at)[some],
                            "n_removed": removed[some],
                            "n_spans": spans[some],
                            "kept": [
                                kept[j - n : j].tobytes()
                                for j, n in zip(
                                    ends[some], (np.diff(own.at) - removed)[some], strict=True
                                )
                            ],
                        },
                        arrow,
                    )
                )
        return pa.Table.from_batches(out, schema=arrow)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)


def without_repeats(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are kept."""
    blocks = written(to_blocks(docs), "blocks")
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    whole = written(judge_runs(send_runs(blocks, shards)), "runs")
    sent = send_bytes(blocks, whole, shards)
    parted = written(judge_bytes(sent, memory), "parted")
    answers = whole.withColumn("whole", F.lit(True)).unionByName(
        parted.withColumn("whole", F.lit(False))
    )
    return remove(blocks, answers, shards)
