"""Log-likelihood of whole documents under a recurrent language model learned from the corpus.

Method: a gated recurrent model (see ``recurrent``) with a class-factored softmax, whose state runs
on from window to window through a whole document. Words are counted over all training
documents: the HEAD most frequent have numbers of their own, the others fall into bins by the
power of two of their count, in which a word has its share of the bin's count. The last bin's
half goes to words that training never saw.

Data flow: tasks number the words of a block of documents; one row for each block and word is
added up over the corpus and goes back to its block, so that what is shuffled are vocabularies
and numbered documents, and no task holds more than a block. The model is started on at most
``SEED_DOCS`` training documents (the first ``SEED_TOKENS`` tokens of each, cut in the tasks); then every task goes on
with every token of all training documents of its own, block by block, and the mean of the tasks'
weights by their tokens is the model, so that what it learns from grows with the corpus.

Words are told apart by 64-bit hashes of their bytes: among 10 million words the chance that any
two are taken for one is 3e-6.

Defined results: a null text is an empty one, whose only token is the end; a null id is the
empty text for the choice of held-out documents; repeated rows are documents of their own;
without training documents every count is 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylake.llm import recurrent as rnn
from delaylake.llm.common import arrow_schema, text_or_empty, to_batch
from delaylake.llm.word_hashes import chunks, words
from delaylake.workspace import written

#: Fixed values of the split.
FOLDS, HELD_OUT = 7, 2

BLOCK_TOKENS = 3_000_000
END_HASH = -1
UNSEEN_SHARE = 0.5
SEED_DOCS, SEED_TOKENS, SEED_STEPS = 400, 4096, 250
SEED_LANES, SEED_RATE = 64, 0.02
LANES, RATE = 256, 0.016
MEAN_OF = 64


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def number_words(docs: DataFrame) -> DataFrame:
    """Documents as numbers of their block's words, and the blocks' words with their counts in
    training documents. Both kinds of rows are in one table: a row has a doc or a vocabulary."""
    schema = (
        "block long, doc_id long, held_out boolean, ids binary, "
        "vocabulary array<struct<i:int, word:long, n:long>>"
    )
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, lengths = np.concatenate(hashes), np.concatenate(sizes)
            out = np.array([held_out(i) for i in ids], dtype=bool)
            vocabulary, number = np.unique(tokens, return_inverse=True)
            trained = np.repeat(~out, lengths)
            counts = np.bincount(number[trained], minlength=len(vocabulary))
            # Frequent words first: small numbers compress well.
            order = np.argsort(-np.bincount(number), kind="stable")
            place = np.empty(len(order), dtype="<i4")
            place[order] = np.arange(len(order))
            numbered = place[number]
            vocabulary, counts = vocabulary[order], counts[order]
            ends = np.cumsum(lengths)
            for first in range(0, len(ids), 2000):
                some = range(first, min(first + 2000, len(ids)))
                yield to_batch(
                    {
                        "block": [block] * len(some),
                        "doc_id": [ids[i] for i in some],
                        "held_out": out[some.start : some.stop],
                        "ids": [
                            compressed(numbered[ends[i] - lengths[i] : ends[i]]) for i in some
                        ],
                        "vocabulary": [None] * len(some),
                    },
                    arrow,
                )
            for first in range(0, len(vocabulary), 50_000):
                part = slice(first, first + 50_000)
                rows = pa.StructArray.from_arrays(
                    [
                        pa.array(np.arange(len(vocabulary))[part], pa.int32()),
                        pa.array(vocabulary[part], pa.int64()),
                        pa.array(counts[part], pa.int64()),
                    ],
                    fields=list(arrow.field("vocabulary").type.value_type),
                )
                yield to_batch(
                    {
                        "block": [block], "doc_id": [None], "held_out": [None], "ids": [None],
                        "vocabulary": pa.ListArray.from_arrays(
                            pa.array([0, len(rows)], pa.int32()), rows
                        ),
                    },
                    arrow,
                )

        pending = 0
        for batch in batches:
            for first, data, at in chunks(batch.column("text")):
                found, counts, _, _ = words(data, at, lower=True)
                where = np.cumsum(counts)
                found = found.view(np.int64)
                hashes.append(np.insert(found, where, END_HASH))
                sizes.append(counts + 1)
                ids += batch.column("doc_id").slice(first, len(counts)).to_pylist()
                pending += len(hashes[-1])
                if pending >= BLOCK_TOKENS:
                    yield from flush()
                    hashes, sizes, ids, pending, block = [], [], [], 0, block + 1
        if ids:
            yield from flush()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def compressed(numbers: np.ndarray) -> bytes:
    """Their number, and the numbers in zstandard."""
    data = np.ascontiguousarray(numbers).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def numbers(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), dtype=kind)


class Corpus:
    """What is known of the whole corpus: bounded by HEAD words and BINS bins."""

    def __init__(self, counted: DataFrame):
        distinct = counted.where("first and c > 0")
        self.train_tokens, self.distinct = distinct.agg(
            F.coalesce(F.sum("c"), F.lit(0)), F.count("*")
        ).first()
        top = (
            distinct.where(F.col("word") != END_HASH)
            .orderBy(F.desc("c"), "word")
            .limit(rnn.HEAD)
            .select("word", "c")
            .collect()
        )
        self.head = [(END_HASH, 0), *((r.word, i + 1) for i, r in enumerate(top))]
        self.counts = np.zeros(rnn.TOKENS)
        self.counts[1 : len(top) + 1] = [r.c for r in top]
        ends = distinct.where(F.col("word") == END_HASH).select("c").first()
        self.counts[0] = ends.c if ends else 0
        self.bin_words = np.zeros(rnn.BINS)
        rare = distinct.join(self.head_table(counted.sparkSession), "word", "left_anti")
        for r in rare.groupBy(_bin().alias("bin")).agg(
            F.count("*").alias("words"), F.sum("c").alias("c")
        ).collect():
            self.counts[1 + rnn.HEAD + r.bin] = r.c
            self.bin_words[r.bin] = r.words

    def head_table(self, spark) -> DataFrame:
        rows = F.from_json(
            F.lit(str([{"word": w, "head": i} for w, i in self.head]).replace("'", '"')),
            "array<struct<word:long,head:int>>",
        )
        return F.broadcast(spark.range(1).select(F.inline(rows)))

    def log_in_bin(self, c: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Logarithm (10) of a rare word's share of its bin."""
        whole = self.counts[1 + rnn.HEAD :][bins]
        with np.errstate(divide="ignore"):
            share = np.where(c > 0, c / np.maximum(whole, 1), 1.0)
        once = self.bin_words[0]
        lowest = np.where(c > 0, (1 - UNSEEN_SHARE) * share, UNSEEN_SHARE if once else 1.0)
        return np.log10(np.where(bins == 0, lowest, share))


def _bin():
    return F.least(F.floor(F.log2(F.col("c"))), F.lit(rnn.BINS - 1)).cast("int")


def count_words(numbered: DataFrame) -> DataFrame:
    """block, i, word, c (the word's count in all training documents), and ``first`` on one row
    of each word. A word has one row for each block, however frequent it is."""
    rows = numbered.where("vocabulary is not null").select("block", F.inline("vocabulary"))
    same = Window.partitionBy("word")
    return rows.select(
        "block", "i", "word",
        F.sum("n").over(same).alias("c"),
        (F.row_number().over(same.orderBy("block")) == 1).alias("first"),
    )


def with_numbers(numbered: DataFrame, counted: DataFrame, corpus: Corpus) -> DataFrame:
    """Documents in the model's numbers, with all that needs no model."""
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
        "rare_score double, ids binary"
    )
    arrow = arrow_schema(numbered.sparkSession, schema)
    denominator = corpus.train_tokens + corpus.distinct + 1

    def run(docs: pa.Table, vocabulary: pa.Table) -> pa.Table:
        size = vocabulary.num_rows
        i = vocabulary.column("i").to_numpy()
        c, head = np.zeros(size, dtype=np.int64), np.full(size, -1)
        c[i] = vocabulary.column("c").to_numpy()
        head[i] = vocabulary.column("head").fill_null(-1).to_numpy()
        base = np.log10((c + 1) / denominator)
        bins = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), rnn.BINS - 1)
        rare = np.where(head < 0, corpus.log_in_bin(c, bins), 0.0)
        token = np.where(head < 0, 1 + rnn.HEAD + bins, head).astype("<u2")
        out = {f.name: [] for f in arrow}
        for doc_id, out_, data in zip(
            *(docs.column(n).to_pylist() for n in ("doc_id", "held_out", "ids")), strict=True
        ):
            own = numbers(data, "<i4")
            row = (doc_id, out_, len(own), int((c[own] > 0).sum()), float(base[own].sum()),
                   float(rare[own].sum()), compressed(token[own]))
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return pa.Table.from_batches([to_batch(out, arrow)], schema=arrow)

    docs = numbered.where("vocabulary is null").select("block", "doc_id", "held_out", "ids")
    found = counted.join(corpus.head_table(numbered.sparkSession), "word", "left")
    vocabulary = found.select("block", "i", "c", "head")
    # As many tasks as blocks, however many partitions other shuffles have.
    blocks = max(1, numbered.where("vocabulary is not null").select("block").distinct().count())
    docs, vocabulary = (x.repartition(blocks, "block") for x in (docs, vocabulary))
    return (
        docs.groupBy("block").cogroup(vocabulary.groupBy("block")).applyInArrow(run, schema)
    )


def learn_all(model: rnn.Params, streams: Iterable[np.ndarray]) -> tuple[rnn.Params, int]:
    """The model after every token of the texts, read in blocks of BLOCK_TOKENS or one text
    more, and the number of tokens."""
    own: list[np.ndarray] = []
    pending = n = 0
    for text in streams:
        own.append(text)
        pending += len(text)
        if pending >= BLOCK_TOKENS:
            model = rnn.train(model, np.concatenate(own), LANES, None, RATE)
            n, pending = n + pending, 0
            own.clear()
    if own:
        model = rnn.train(model, np.concatenate(own), LANES, None, RATE)
    return model, n + pending


def fit(docs: DataFrame, corpus: Corpus) -> rnn.Params:
    """Started on a bounded sample, then learned on in every task; the mean of all."""
    trained = docs.where("not held_out")
    cut = F.xxhash64("doc_id")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut_ = [numbers(x, "<u2")[:SEED_TOKENS].tobytes() for x in batch.column(0).to_pylist()]
            yield pa.record_batch({"start": pa.array(cut_, pa.binary())})

    sample = (
        trained.orderBy(cut, "doc_id").limit(SEED_DOCS).select("ids")
        .mapInArrow(starts, "start binary").collect()
    )
    model = rnn.initial(corpus.counts)
    if not sample:
        return model
    stream = np.concatenate([np.frombuffer(r.start, dtype="<u2") for r in sample])
    model = rnn.train(model, stream, SEED_LANES, SEED_STEPS, SEED_RATE)
    start = rnn.pack(model)
    schema = "part long, n long, weights binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = (numbers(x, "<u2") for batch in batches for x in batch.column(0).to_pylist())
        learned, n = learn_all(rnn.unpack(start), streams)
        if n:
            part = TaskContext.get().partitionId()
            yield to_batch({"part": [part], "n": [n], "weights": [rnn.pack(learned)]}, arrow)

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy().astype(np.float64)
        all_ = [np.frombuffer(w, dtype="<f4") for w in table.column("weights").to_pylist()]
        weights = sum(w * x for w, x in zip(all_, n / n.sum(), strict=True)).astype("<f4")
        columns = {"part": [key[0].as_py()], "n": [int(n.sum())], "weights": [weights.tobytes()]}
        return pa.Table.from_batches([to_batch(columns, arrow)], schema=arrow)

    models = written(trained.select("ids").mapInArrow(learn, schema), "models")
    while (parts := models.count()) > 1:
        groups = -(-parts // MEAN_OF)
        spread = models.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups).cast("long")))
        models = written(spread.groupBy("part").applyInArrow(mean, schema), "models")
    last = models.first()
    return rnn.unpack(last.weights) if last else model


def lm_scores(docs: DataFrame) -> DataFrame:
    numbered = written(number_words(docs), "numbered")
    counted = written(count_words(numbered), "counted")
    corpus = Corpus(counted)
    ready = written(with_numbers(numbered, counted, corpus), "model_numbers")
    weights = rnn.pack(fit(ready, corpus))
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    arrow = arrow_schema(docs.sparkSession, schema)
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rnn.unpack(weights)
        rows: list[tuple] = []
        texts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found = rnn.score(model, texts) / np.log(10)
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            rare = np.array(columns.pop("rare_score"))
            columns |= {"score": found + rare, "train_tokens": [corpus.train_tokens] * len(rows)}
            return to_batch(columns, arrow)

        for batch in batches:
            rows += zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            texts += [numbers(x, "<u2") for x in batch.column("ids").to_pylist()]
            if sum(map(len, texts)) >= BLOCK_TOKENS:
                yield flush()
                rows.clear()
                texts.clear()
        if rows:
            yield flush()

    return ready.mapInArrow(run, schema)
