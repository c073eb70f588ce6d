"""Byte-level byte-pair ids of texts, with a bounded store of words already met."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Characters below U+0100 by class, as the vocabulary's pattern has them.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"

NARROW = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
OUTSIDE = re.compile("[^\x00-\xff]")
MOST_WORDS = 400_000


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order,
    as the characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Ids as the tokenizers library gives them for the file at ``path``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.library = Tokenizer.from_file(path)
        ranks = {
            bytes(to_byte[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.piece = tiktoken.Encoding(
            "own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids, each as four little-endian bytes."""
        if OUTSIDE.search(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        words = NARROW.findall(text)
        get = self.known.__getitem__
        try:
            return b"".join(map(get, words))
        except KeyError:
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            for word in words:
                if word not in self.known:
                    ids = self.piece(word.encode())
                    self.known[word] = np.array(ids, dtype="<u4").tobytes()
            return b"".join(map(get, words))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(path)
