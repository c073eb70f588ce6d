"""Linked tokens against every pair of every group, taken one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD_TEXTS, with_clashes

from delaylake.llm import token_alignment
from delaylake.llm.byte_bpe import byte_of_char
from delaylake.llm.common import read

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MORE_TEXTS = [
    "▁ already a mark", "a▁b", "<s> hi </s> <unk> <0x41>", "<|endoftext|>", " leading",
    "trailing ", "tab\tand\r\nbreak", " " * 700 + "x" + "\n" * 300, "é" * 50 + "😀" * 20, "\x00\x01",
    "aaaa" * 200, "-" * 333, "= " * 99,
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def one(libraries, text):
    """Groups of one text: lists of (ids of A, ids of B)."""
    a, b = libraries
    if not text:
        return []
    to_byte = byte_of_char()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [
        bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)
    ]
    whole = b" " + text.encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    groups, i, k = [], 0, 0
    while i < len(ids_a):
        j, m, end_a, end_b = i + 1, k + 1, len(bytes_a[i]), len(bytes_b[k])
        while end_a != end_b:
            if end_a < end_b:
                end_a, j = end_a + len(bytes_a[j]), j + 1
            else:
                end_b, m = end_b + len(bytes_b[m]), m + 1
        groups.append((ids_a[i:j], ids_b[k:m]))
        i, k = j, m
    return groups


def brute(libraries, docs):
    cut = [(i, one(libraries, t)) for i, t in docs]
    linked = [[(x, y) for a, b in groups for x in a for y in b] for _, groups in cut]
    count = Counter(p for pairs in linked for p in set(pairs))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for (doc_id, groups), pairs in zip(cut, linked, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out[
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
            len(pairs), sum(count[p] == highest[p[0]] for p in pairs), sum(count[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ] += 1
    return out


def check(spark, libraries, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frame = with_clashes(frame, "block", "a", "b", "n", "pairs", "n_a", "is_doc", "count")
    found = token_alignment.align(frame, *PATHS)
    assert found.columns == COLUMNS
    assert Counter(map(tuple, found.collect())) == brute(libraries, docs)


def test_awkward_texts(spark, libraries):
    texts = AWKWARD_TEXTS + MORE_TEXTS + AWKWARD_TEXTS[3:9]
    check(spark, libraries, [(i % 30 if i % 11 else None, t) for i, t in enumerate(texts)])


@pytest.mark.parametrize("many", [1, 4, 10**9])
def test_large_groups_are_linked_alike(monkeypatch, many):
    rng = np.random.default_rng(many)
    monkeypatch.setattr(token_alignment, "MANY_LINKS", many)
    a, b = rng.integers(0, 6, 400), rng.integers(0, 5, 300)
    to_a = np.append(np.sort(rng.choice(np.arange(1, 400), 40, replace=False)), 400)
    to_b = np.append(np.sort(rng.choice(np.arange(1, 300), 40, replace=False)), 300)
    wanted, i, k = Counter(), 0, 0
    for j, m in zip(to_a, to_b, strict=True):
        wanted.update(int(x * 7 + y) for x in a[i:j] for y in b[k:m])
        i, k = j, m
    pairs, times = token_alignment.links(a, b, to_a, to_b, 7)
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == wanted
    assert sorted(pairs) == pairs.tolist()


def test_small_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_TOKENS", 60)
    rng = random.Random(3)
    vocabulary = ["the", "unbelievable", "straße", "漢字", "x1", "Ωmega", "naïvely", "\n\n", "(a)", "😀"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(20)))) for i in range(200)]
    check(spark, libraries, docs)


def test_empty_tables(spark, libraries):
    check(spark, libraries, [])
    check(spark, libraries, [(0, None), (1, ""), (None, None)])


def test_long_texts(spark, libraries):
    rng = random.Random(4)
    words = ["data", "tokenizers", "être", "don't", "42", "…", "    ", "\n"]
    long = " ".join(rng.choices(words, k=1_100_000))
    assert len(long) > 5_000_000
    runs = [c * 20_000 for c in (" ", "x", "x ", "\n", "1", "!", "é\xa0")]
    runs.append("\t" * 199 + "x")
    check(spark, libraries, [(0, long), (1, "data être"), *enumerate(runs, 2)])


def test_both_libraries_give_the_same_ids():
    both = token_alignment.Tokenizers(*PATHS)
    rng = random.Random(2)
    letters = [chr(i) for i in range(256)] + [*"  \n'stmdlvre"] * 8
    for n in range(3000):
        text = "".join(rng.choices(letters, k=n % 80))
        ids = np.frombuffer(both.careful.encode(text), dtype="<u4").tolist()
        assert both.fast.encode_ordinary(text) == ids


def test_given_documents(spark, libraries):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    found = Counter(map(tuple, token_alignment.align(docs, *PATHS).collect()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found == brute(libraries, rows)
    assert sum(r[1] > 0 for r in found) > 150
