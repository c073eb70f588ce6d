"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from cases import AWKWARD_TEXTS, documents, with_clashes

from delaylake.llm import lexical_search, oracle, queries
from oracle_check import connect, differences

CLASHES = ("item", "score", "rank", "n_docs", "ends", "docs")


def terms(text):
    found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in counted:
            room = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in set(terms(text)) & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1)))
                score += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * room))
            if score > 0:
                scored.append((-score, i is None, i))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(best, 1)]
    return Counter(out)


def check(spark, docs, items, k=5):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    found = lexical_search.rank_documents(with_clashes(d, *CLASHES), with_clashes(q, *CLASHES, "doc_id"), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(docs, items, k)


def words(rng, n, vocabulary=40):
    # The low numbers are frequent.
    return " ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


def test_awkward_texts(spark):
    docs = [(i if i % 5 else None, t) for i, t in enumerate(AWKWARD_TEXTS * 2)]
    items = [(i, t) for i, t in enumerate(AWKWARD_TEXTS)] + [(None, "same text"), (3, "A B c")]
    check(spark, docs, items)


@pytest.mark.parametrize(("k", "shard"), [(1, 7), (3, 40), (10, 1000), (400, 50)])
def test_random_texts(spark, monkeypatch, k, shard):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 200)
    rng = random.Random(k)
    docs = [(i // 2, words(rng, rng.randrange(1, 30))) for i in range(300)]
    items = [(i, words(rng, rng.randrange(0, 25), 60)) for i in range(20)]
    check(spark, docs, items, k)


def test_ties(spark):
    docs = [(i, f"common word{i % 3}") for i in range(200, 0, -1)] + [(None, "common word1")] * 4
    check(spark, docs, [(0, "word1 common"), (1, "word2"), (2, "common"), (3, "nothing")], 70)


def test_shards_by_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 30)
    rng = random.Random(9)
    docs = [(i, words(rng, 20)) for i in range(100)]
    check(spark, docs, [(i, words(rng, 10)) for i in range(5)], 4)


def test_empty_tables(spark):
    check(spark, [], [(0, "a b")])
    check(spark, [(0, "a b")], [])
    check(spark, [(0, None), (1, "-")], [(0, "a b")])
    check(spark, [(0, "a b")], [(0, None), (1, "!")])


def test_long_texts(spark):
    rng = random.Random(5)
    long = words(rng, 1_500_000, 5000)
    assert len(long) > 6_000_000
    docs = [(0, long), (1, "x" * 6_000_000), *((i, words(rng, 10, 5000)) for i in range(2, 60))]
    check(spark, docs, [(0, long), (1, "w1 w2 w3 w4999"), (2, "x" * 6_000_000)], 20)


def test_accumulators_are_limited():
    """A document that only a frequent term would bring in opens none."""
    rare, frequent = 3, 500
    row = {
        "held": b"\1" * 500,
        "doc_ids": lexical_search.np.arange(500, dtype="<i8").tobytes(),
        "sizes": lexical_search.np.full(500, 10, dtype="<i8").tobytes(),
        "ends": lexical_search.np.array([rare, rare + frequent], dtype="<i8").tobytes(),
        "docs": lexical_search.np.concatenate([[5, 6, 7], range(500)]).astype("<u4").tobytes(),
        "times": lexical_search.np.ones(503, dtype="<u4").tobytes(),
    }
    weights = lexical_search.np.array([5000, 10])
    shard = lexical_search._Shard(row, weights, 500, 5000)
    opened = []
    shard.is_open = _Watched(shard.is_open, opened)
    assert [p for _, p in shard.best([0, 1], 2, 0)] == [5, 6]
    assert sorted(opened) == [5, 6, 7]


class _Watched:
    def __init__(self, array, opened):
        self.array, self.opened = array, opened

    def __getitem__(self, at):
        return self.array[at]

    def __setitem__(self, at, value):
        if value:
            self.opened += list(at)
        self.array[at] = value


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf_dir):
    found = queries.op11_lexical_search(spark, sf_dir)
    assert differences(found, connect(sf_dir), oracle.ORACLE_SQL["op11_lexical_search"]) == ""


def test_documents_without_ids_count(spark):
    some = documents(spark, ["a b", "a c", "b d"]).selectExpr("if(doc_id = 1, null, doc_id) doc_id", "text")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    found = lexical_search.rank_documents(some, items).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(found)] == [(1, 0), (2, None)]
