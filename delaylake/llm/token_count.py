"""Counting the tokens of texts without making them.

Method: byte-pair merging over a heap and a linked list. A word starts as its bytes. The heap
holds the rank and place of every adjacent pair that can merge; the lowest is popped again and
again, its two symbols become one, and the pairs with the neighbours are pushed. The count is
the number of symbols at first minus the number of merges; no identifiers are made. Equal words
have equal counts, so each worker keeps a bounded store of words it has counted.

Defined results: a null text is an empty one, with no tokens; special strings inside texts
count one each; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from delaylake.llm.byte_bpe import byte_of_char
from delaylake.llm.common import map_batches, text_or_empty

LIMIT = 2048
MOST_WORDS = 400_000

#: Characters below U+0180 by class, as the vocabulary's pattern has them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
NARROW = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
)
OUTSIDE = re.compile("[^\x00-ſ]")


class MergeRanks:
    """The merge rules of a file of the tokenizers library, as pairs of symbol numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.word_end = spec["model"]["end_of_word_suffix"] or ""
        number: dict[str, int] = {}

        def symbol(text: str) -> int:
            return number.setdefault(text, len(number))

        char = {b: c for c, b in byte_of_char().items()}
        self.inner = [symbol(char[b]) for b in range(256)]
        self.last = [symbol(char[b] + self.word_end) for b in range(256)]
        self.char = byte_of_char()
        self.pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[symbol(left), symbol(right)] = (rank, symbol(left + right))
        self.counts: dict[str, int] = {}

    def word_tokens(self, word: bytes) -> int:
        """Symbols at first minus merges."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        size, pairs = len(symbols), self.pairs
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue  # one of the two has merged since
            symbols[i], symbols[j] = made, -1
            merges += 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if found := pairs.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], made))
        return size - merges

    def words(self, text: str) -> list[str]:
        if not OUTSIDE.search(text):
            # Below U+0180 every character is composed already, and white space parts words only.
            return NARROW.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [
            bytes(self.char[c] for c in w).decode(errors="surrogateescape")
            for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
        ]

    def text_tokens(self, text: str) -> int:
        if self.special and "<" in text:
            special = len(self.special.findall(text))
            if special:
                return special + sum(map(self.text_tokens, self.special.split(text)))
        words = self.words(text)
        try:
            return sum(map(self.counts.__getitem__, words))
        except KeyError:
            if len(self.counts) > MOST_WORDS:
                self.counts.clear()
            for word in words:
                if word not in self.counts:
                    self.counts[word] = self.word_tokens(word.encode(errors="surrogateescape"))
            return sum(map(self.counts.__getitem__, words))


@lru_cache(maxsize=2)
def merge_ranks(path: str) -> MergeRanks:
    """One for each worker process."""
    return MergeRanks(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def work(batch: pa.RecordBatch):
        ranks = merge_ranks(vocabulary)
        texts = batch.column(1).to_pylist()
        tokens = [ranks.text_tokens(t) for t in texts]
        yield {
            "doc_id": batch.column(0),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return map_batches(
        docs.select("doc_id", text_or_empty().alias("text")),
        work,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
