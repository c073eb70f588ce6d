import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD_TEXTS, documents, with_clashes
from tokenizers import Tokenizer

from delaylake.llm.byte_bpe import byte_bpe
from delaylake.llm.common import read
from delaylake.llm.packing import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, library, size=2048):
    """Every id in exactly one piece, no gap in a sequence, no sequence too long."""
    whole = {i: expected_ids(library, t) for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(whole[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in whole.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        total += at
        padded += at if at & (at - 1) == 0 else size
    return padded / total


def test_ids_are_the_librarys(library):
    own = byte_bpe(PATH)
    for text in AWKWARD_TEXTS:
        if text is not None:
            found = np.frombuffer(own.encode(text), dtype="<u4").tolist()
            assert found == library.encode(text, add_special_tokens=False).ids, text


def test_awkward_texts(spark, library):
    docs = with_clashes(documents(spark, AWKWARD_TEXTS).repartition(3), "ids", "offset", "at")
    check(pack(docs, PATH).collect(), dict(enumerate(AWKWARD_TEXTS)), library)


def test_ids_column(spark):
    rows = pack(documents(spark, AWKWARD_TEXTS), PATH).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_given_table(spark, library):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack(docs.repartition(4, "doc_id"), PATH, with_ids=False).collect()
    assert check(rows, texts, library) < 1.01


def test_small_windows(spark, library):
    texts = ["one two three four five six seven " * (i % 9) for i in range(200)]
    docs = documents(spark, texts).repartition(5)
    rows = pack(docs, PATH, size=64, open_windows=4).collect()
    assert check(rows, dict(enumerate(texts)), library, 64) < 1.2


def test_same_rows_again(spark):
    docs = documents(spark, ["some words to pack " * (i % 50) for i in range(300)])
    assert sorted(pack(docs, PATH).collect()) == sorted(pack(docs, PATH).collect())


def test_empty_table(spark):
    assert pack(documents(spark, ["x"]).where("false"), PATH).collect() == []
