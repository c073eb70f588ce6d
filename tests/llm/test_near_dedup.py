import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD_TEXTS, documents, with_clashes
from oracle_check import connect, differences

from delaylake.llm import near_dedup
from delaylake.llm.components import components
from delaylake.llm.common import read
from delaylake.llm.near_dedup import (
    REGISTERS,
    find_near_duplicates,
    signatures,
    without_near_duplicates,
)
from delaylake.llm.oracle import ORACLE_SQL
from delaylake.llm.word_hashes import chunks, shingles, words


def bag(text):
    found = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").translate(
        {9: 32, 10: 32, 13: 32}).split(" ") if w]
    return Counter(
        tuple(found[i : i + 5]) for i in range(max(len(found) - 4, min(len(found), 1)))
    )


def similarity(a, b):
    common = sum((a & b).values())
    whole = sum((a | b).values())
    return common / whole if whole else 1.0


def brute_classes(texts):
    """Classes by comparing all pairs that share a shingle."""
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    places = {}
    for i, b in enumerate(bags):
        for s in b or [None]:
            places.setdefault(s, []).append(i)
    seen = set()
    for members in places.values():
        for x, i in enumerate(members):
            for j in members[:x]:
                if (j, i) in seen:
                    continue
                seen.add((j, i))
                if similarity(bags[i], bags[j]) >= 0.8:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return [root(i) for i in range(len(texts))]


def check(spark, texts, docs=None):
    docs = documents(spark, texts) if docs is None else docs
    rows = find_near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(brute_classes(texts)))
    assert all(r.is_first == (r.doc_id == r.class_id) for r in rows)
    assert len(rows) == len(texts)


def edited(rng, text, n):
    out = text.split()
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("alpha beta gamma delta".split())
    return " ".join(out)


def some_text(rng, n):
    return " ".join(str(rng.randrange(3000)) for _ in range(n))


def test_words_and_shingles():
    texts = pa.array([t or "" for t in AWKWARD_TEXTS])
    for _, data, at in chunks(texts):
        hashes, counts, starts, ends = words(data, at)
        found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
        expected = [
            w for t in AWKWARD_TEXTS for shingle in [bag(t)] for w in _words(t) if shingle or w
        ]
        assert found == expected
        assert len(set(hashes.tolist())) == len(set(found))
        runs, n = shingles(hashes, counts, 5)
        assert n.tolist() == [sum(bag(t).values()) for t in AWKWARD_TEXTS]
        at = 0
        for t, size in zip(AWKWARD_TEXTS, n, strict=True):
            assert sorted(Counter(runs[at : at + size].tolist()).values()) == sorted(
                bag(t).values()
            )
            at += size


def _words(text):
    table = {c: 32 for c in (9, 10, 11, 12, 13)}
    return [w for w in (text or "").translate(table).split(" ") if w]


def test_registers_agree_as_often_as_the_bags_overlap():
    rng = random.Random(3)
    errors = []
    for _ in range(60):
        common = [rng.randrange(10**9) for _ in range(rng.randrange(20, 80))]
        a = Counter({x: rng.choice([1, 1, 1, 2, 3, 7, 20]) for x in common})
        b = Counter({x: max(1, w + rng.choice([0, 0, 1, -2, 5])) for x, w in a.items()})
        both = [np.array(sorted(x.elements()), dtype=np.uint64) for x in (a, b)]
        with np.errstate(over="ignore"):
            hashes = np.concatenate(both) * np.uint64(0x9E3779B97F4A7C15)
        found = signatures(hashes, np.array([len(x) for x in both]))
        assert (found != 0).all()
        errors.append(np.mean(found[0] == found[1]) - similarity(a, b))
    # The mean of 60 * 120 draws.
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(60 * REGISTERS)


def test_awkward_texts(spark):
    texts = AWKWARD_TEXTS + AWKWARD_TEXTS
    check(spark, texts, with_clashes(documents(spark, texts), "_row", "node", "root", "band"))


def test_edited_copies(spark):
    rng = random.Random(1)
    texts = []
    for i in range(40):
        text = some_text(rng, rng.randrange(30, 400))
        texts += [text, text, edited(rng, text, 1), edited(rng, text, 1 + i % 12)]
    check(spark, texts)


@pytest.mark.parametrize("few,tile", [(100, 256), (0, 8), (10**9, 256)])
def test_large_group_with_outsiders(spark, monkeypatch, few, tile):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = random.Random(2)
    text = some_text(rng, 200)
    texts = [edited(rng, text, 2) for _ in range(150)] + [edited(rng, text, 12) for _ in range(60)]
    check(spark, texts)


def test_heavy_weights(spark):
    texts = ["one two three four five " * n for n in (3, 4, 30, 31, 40, 300, 310, 500)]
    check(spark, texts)


def test_given_table(spark):
    rows = read(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    found = find_near_duplicates(read(spark, f"/root/testdata/{sf}", "documents"))
    sql = ORACLE_SQL["op1_near_dedup"]
    assert differences(found, connect(f"/root/testdata/{sf}"), sql) == ""


def test_documents_are_kept_whole(spark):
    docs = with_clashes(documents(spark, ["a b c d e f", None, "a b c d e f", "x"]), "_doc_x")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 3}


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame(
        [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "q")],
        "doc_id long, text string",
    )
    rows = sorted(find_near_duplicates(docs).collect(), key=str)
    assert [(r.doc_id, r.class_id) for r in rows] == [(7, 7), (7, 7), (None, 7), (None, None)]
    assert sum(r.is_first for r in rows) == 2


def test_empty_table(spark):
    assert find_near_duplicates(documents(spark, ["x"]).where("false")).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)]
    edges += [(i, i + 1) for i in range(100, 140)]
    expected = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == expected
    assert len(found) == len(expected)


@pytest.mark.parametrize("few", [0, 100])
def test_pair_at_the_threshold_whose_registers_agree_seldom(spark, monkeypatch, few):
    # Exactly 0.8 alike, and 78 of the registers agree; left to what comes after the rounds.
    rng = random.Random(645)
    text = [str(rng.randrange(10**9)) for _ in range(184)]
    other = [f"other{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(text)]
    stars = near_dedup._stars
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "_stars", lambda *args: stars(*args).where("false"))
    check(spark, [" ".join(text), " ".join(other)])


@pytest.mark.parametrize("seed", range(6))
def test_components_of_random_graphs(spark, seed):
    """Chains, stars around any node, rings, repeated and empty edges, against a search."""
    rng = random.Random(seed)
    n = 60
    edges = [(i, i + 1) for i in range(0, 12)] + [(40, i) for i in range(30, 40)]
    edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(8 * seed)] + [(5, 5), (30, 40)]
    rng.shuffle(edges)
    near = {i: {i} for e in edges for i in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    wanted = {}
    for start in sorted(near):
        open_ = [start] if start not in wanted else []
        while open_:
            node = open_.pop()
            if node not in wanted:
                wanted[node] = start
                open_ += near[node]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert sorted(map(tuple, found)) == sorted((i, r) for i, r in wanted.items() if i in linked)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_registers_are_two_bytes_each_wherever_they_are_moved(spark):
    """As text they took sixteen, in the shuffle by nodes and in the one by bands."""
    rows = near_dedup.numbered(spark.createDataFrame([(1, "a b c d e f"), (2, "")], "doc_id long, text string"))
    signed = near_dedup.sign(rows)
    assert dict(signed.dtypes)["registers"] == "array<smallint>"
    registers = {r.doc_id: r.registers for r in signed.collect()}
    assert len(registers[1]) == len(registers[2]) == REGISTERS
    assert any(registers[1]) and not any(registers[2])


def test_end_of_components_is_told_by_the_smallest_neighbours(spark, monkeypatch):
    from delaylake.llm import components as module

    labels, write = [], module.written

    def watched(df, label):
        labels.append(label)
        return write(df, label)

    monkeypatch.setattr(module, "written", watched)
    # Steps, and the table that says that nothing is left to do: no other pass looks for that.
    found = components(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    steps = labels.count("smallest") // 2
    assert labels == ["edges", *["smallest", "edges"] * 2 * steps, "smallest"]


def test_tables_of_components_have_files_by_their_edges(spark, monkeypatch):
    """Not one for each shuffle partition that has rows, which made each step as many tasks."""
    from delaylake.llm import components as module

    tables, write = [], module.written

    def watched(df, label):
        tables.append(write(df, label))
        return tables[-1]

    edges = [(i, i + 1) for i in range(200)]
    monkeypatch.setattr(module, "written", watched)
    settings = {
        "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for rows, most in ((100_000, 1), (50, 5)):
            monkeypatch.setattr(module, "FILE_ROWS", rows)
            tables.clear()
            found = components(spark.createDataFrame(edges, "a long, b long"))
            assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(201)]
            assert max(len(t.inputFiles()) for t in tables[1:]) == most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
