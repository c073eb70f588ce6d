import hashlib
import random

import numpy as np
import pytest
from cases import AWKWARD_TEXTS, documents, with_clashes
from oracle_check import connect, differences

from delaylake.llm import byte_dedup
from delaylake.llm.byte_dedup import equal_windows, packed, unpacked, without_repeats
from delaylake.llm.common import read
from delaylake.llm.induced_sort import sort_suffixes
from delaylake.llm.oracle import ORACLE_SQL
from delaylake.llm.queries import op10_suffix_dedup


def brute(docs):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of (doc_id, text) pairs."""
    large = 1 << 63
    first = {}
    data = [((large if i is None else i), i, (t or "").encode()) for i, t in docs]
    for d, _, b in data:
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < d:
                gone[s : s + 50] = b"\1" * 50
        spans = bytes(gone).split(b"\0")
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for s in spans if s), kept))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    return sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str
    )


@pytest.mark.parametrize("alphabet,size", [(1, 50), (2, 300), (2, 2000), (4, 3000), (250, 2000)])
@pytest.mark.parametrize("memory", [1, 100, 10**7])
def test_suffix_order(alphabet, size, memory):
    rng = np.random.default_rng(size)
    text = np.append(rng.integers(1, alphabet + 1, size), 0).astype(np.int16)
    order = np.concatenate(list(sort_suffixes(text, alphabet + 1, memory)))[::-1]
    data = [tuple(text[i:]) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: data[i])


def test_equal_windows():
    rng = random.Random(1)
    base = [rng.choice([0, 255, 65]) for _ in range(90)]
    texts = [base, base[3:80], base[10:] + [7], [1] * 60, [1] * 55, base[:60]]
    docs = np.array([5, 3, 9, 4, 4, 5])
    windows = np.array([len(t) - 49 for t in texts])
    i, w = equal_windows(np.array(sum(texts, []), dtype=np.uint8), windows, docs, 50)
    pieces = {}
    for n, t in enumerate(texts):
        for s in range(len(t) - 49):
            pieces.setdefault(bytes(t[s : s + 50]), []).append((n, s))
    expected = {
        (n, s) for ms in pieces.values() for n, s in ms if docs[n] > min(docs[m] for m, _ in ms)
    }
    assert set(zip(i.tolist(), w.tolist(), strict=True)) == expected


def test_packed_numbers():
    columns = [
        np.array([], dtype=np.uint64), np.array([0, 0]), np.array([1, 2**63 - 1, 255]),
        np.array([2**64 - 1], dtype=np.uint64),
    ]
    for a, b in zip(columns, unpacked(packed(*columns)), strict=True):
        assert a.astype(np.uint64).tolist() == b.tolist()


def passages(rng, n):
    words = [rng.choice("th er on an re he in ed nd ha at en es of".split()) for _ in range(n)]
    return "".join(w + rng.choice(["", "", " "]) for w in words)


def corpus(rng, n):
    shared = [passages(rng, rng.randrange(15, 80)) for _ in range(8)]
    texts = []
    for i in range(n):
        parts = [passages(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(4)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece) // 2)
            parts += [piece[cut:] if rng.random() < 0.5 else piece, passages(rng, rng.randrange(20))]
        if texts and rng.random() < 0.3:
            parts = [rng.choice(texts)]
            if rng.random() < 0.7:
                at = rng.randrange(len(parts[0]) + 1)
                parts = [parts[0][:at], rng.choice(["", "é", "XY"]), parts[0][at + 1 :]]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(byte_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(seed)
    texts = corpus(rng, 120)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(without_repeats(frame, memory=500)) == brute(docs)


def test_awkward_texts(spark):
    texts = AWKWARD_TEXTS + AWKWARD_TEXTS[::-1] + ["y" + "x" * 200, "x" * 49, "x" * 50]
    docs = with_clashes(documents(spark, texts).repartition(3), "block", "shard", "kept")
    assert found(without_repeats(docs)) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    a, b = "abcdefghij" * 6, "0123456789" * 7
    docs = [(3, a), (3, a), (None, a + b), (None, a + b), (2, b), (-5, "q" + b), (7, a[:49])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(without_repeats(frame)) == brute(docs)


def test_many_blocks(spark, monkeypatch):
    rng = random.Random(9)
    texts = corpus(rng, 60)
    shared = passages(rng, 200)
    texts += [passages(rng, 10) + shared + passages(rng, 10) for _ in range(60)]
    frame = documents(spark, texts).repartition(16)
    assert found(without_repeats(frame)) == brute(list(enumerate(texts)))


def test_given_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(rows)]
    own = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in found(without_repeats(docs))]
    assert own == expected


def test_sql(spark):
    found = op10_suffix_dedup(spark, "/root/testdata/sf0.001")
    sql = ORACLE_SQL["op10_suffix_dedup"]
    assert differences(found, connect("/root/testdata/sf0.001"), sql) == ""


def test_empty_table(spark):
    assert without_repeats(documents(spark, ["x"]).where("false")).collect() == []
