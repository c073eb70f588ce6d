import math
import re
from collections import Counter

import pytest
from cases import AWKWARD_TEXTS, documents, with_clashes
from oracle_check import connect, differences
from pyspark.sql import functions as F

from delaylake.llm import quality_rules as q
from delaylake.llm.common import read
from delaylake.llm.oracle import ORACLE_SQL

WHITE = "\x20\x09-\x0d"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{WHITE}]+", text)
    spans = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(spans)
    again = {i + d for i, s in enumerate(spans) if often[s] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(f"[^{WHITE}]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(again),
        len(words) < 10 or 100 * len(again) > 20 * len(words),
    )


def counts(r):
    return (
        r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
    )


NO_LABELS = "doc_id long, quality int, toxic int"


def test_awkward_texts(spark):
    texts = AWKWARD_TEXTS + [
        "a b c d e " * 3, "x a b c d e y a b c d e z", "a a a a a a", "l1\nl2\n\n \nl1\nl1\n",
        " ".join(map(str, range(200))) + " 1 2 3 4 5 6",
    ]
    docs = with_clashes(documents(spark, texts), "m", "stratum", "cutoffs", "n_words")
    rows = q.judge(docs, spark.createDataFrame([], NO_LABELS)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert counts(r) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    tables = [read(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels")]
    sql = ORACLE_SQL["op8_quality_rules"]
    assert differences(q.judge(*tables), connect(f"/root/testdata/{sf}"), sql) == ""


def at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_binomial(spark):
    cases = [(k, n, p) for n in (1, 2, 30, 500) for k in (0, 1, 2, 7) for p in (0.004, 0.05) if k <= n]
    for p in (0.004, 0.05):
        rows = [(k, n) for k, n, x in cases if x == p] + [(100, 5000)]
        found = (
            spark.createDataFrame(rows, "k long, n long")
            .select("k", "n", q.binomial_at_most(F.col("k"), F.col("n"), p).alias("b"))
            .collect()
        )
        for r in found:
            if r.k >= r.n * p:
                assert r.b == 1.0
            else:
                assert math.isclose(r.b, at_most(r.k, r.n, p), rel_tol=1e-9)


def test_binomial_of_many(spark):
    row = spark.createDataFrame([(3_990_000, 10**9)], "k long, n long")
    found = row.select(q.binomial_at_most(F.col("k"), F.col("n"), 0.004).alias("b")).first().b
    # The normal approximation, five standard deviations below.
    z = (3_990_000.5 - 4_000_000) / math.sqrt(4_000_000 * 0.996)
    assert math.isclose(found, 0.5 * math.erfc(-z / math.sqrt(2)), rel_tol=0.02)


def labelled_corpus(spark, n, symbols):
    """Good documents, of which some have a few symbols, and poor ones with many."""
    plain = " ".join(f"w{i}" for i in range(40))
    texts = [f"{plain} d{i} " + ("# " * symbols if i % 200 == 0 else "") for i in range(n)]
    texts += [f"{plain} p{i} " + " ".join(f"#{j}#" for j in range(15)) for i in range(n // 4)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame(
        [(i, int(i < n), 0) for i in range(len(texts))] + [(None, 1, 0), (5, None, None)], NO_LABELS
    )
    return docs, labels


def test_cutoffs_match_the_exact_test(spark):
    docs, labels = labelled_corpus(spark, 4000, 3)
    measured = q.measure(docs)
    risk, delta = 0.01, 0.05
    cut = q.fit_cutoffs(measured, labels, risk, delta).collect()[0].cutoffs
    tests = sum(map(len, q.RULES.values()))
    shares = []
    for r in measured.where("doc_id < 4000").select(
        *[v.alias(k) for k, v in q.ratios(F.col("m")).items()]
    ).collect():
        shares.append(r)
    for rule, cutoffs in q.RULES.items():
        rejected = [sum(s[rule] > c for s in shares) for c in cutoffs]
        sure = [
            c for c, k in zip(cutoffs, rejected, strict=True)
            if at_most(k, len(shares), risk) <= delta / tests
        ]
        assert cut[rule] == (sure[0] if sure else None)
    rows = q.judge(docs, labels, risk, delta).collect()
    assert sum(not r.kept for r in rows if r.doc_id < 4000) <= 4 * risk * 4000
    assert not any(r.kept for r in rows if r.doc_id >= 4000)


def test_few_labels_reject_nothing_more(spark):
    docs, labels = labelled_corpus(spark, 200, 0)
    assert all(r.kept != r.base_failed for r in q.judge(docs, labels).collect())


def test_strata_have_their_own_cutoffs(spark):
    docs, labels = labelled_corpus(spark, 4000, 0)
    both = docs.unionByName(
        docs.withColumns({"lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 100000})
    )
    rows = q.judge(both, labels).collect()
    poor = [r for r in rows if r.doc_id % 100000 >= 4000]
    assert all(r.kept == (r.doc_id >= 100000) for r in poor)


def test_documents_are_kept_whole(spark):
    docs, labels = labelled_corpus(spark, 2400, 0)
    docs = with_clashes(docs, "m", "_stratum", "cutoffs")
    out = q.keep_good(docs, labels)
    assert out.columns == docs.columns
    expected = {r.doc_id for r in q.judge(docs, labels).collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == expected


def test_empty_tables(spark):
    docs, labels = documents(spark, ["x"]).where("false"), spark.createDataFrame([], NO_LABELS)
    assert q.judge(docs, labels).collect() == [] and q.keep_good(docs, labels).collect() == []
