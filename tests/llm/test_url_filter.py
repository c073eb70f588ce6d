"""Listed rules, mined rules against all combinations, and awkward urls."""

import re
from collections import Counter
from itertools import chain, combinations

import pytest

from delaylake.llm import oracle, queries, url_filter
from oracle_check import connect, differences

SMALL = "/root/testdata/sf0.001"

URLS = [
    None,
    "",
    "no scheme example.net/en/",
    "http://",
    "http://example.net",
    "http://EXAMPLE.net/en/1",
    "https://a.b.example.net/en/2?x=1&y=2&&=3#top",
    "https://badexample.net/en/3",
    "https://xnet/en/4",
    "http://example.com/de/5.html",
    "http://example.com/de",
    "http://example.com/DE/6",
    "ftp://m.example.org/fr/7/",
    "ftp://org/fr/",
    "x://a://b.net/c",
    "http://straße.NET/é/8",
    "http://a.net?net/#/en/",
    "http://a..net/../9",
    "http://example.com/en/1.2.3.tar.gz?" + "&".join(f"p{i}=1" for i in range(40)),
    "http://example.com/" + "long/" * 200_000 + "x",
    "http://line\nbreak.net/a\nb\n",
]


def parts(url):
    found = re.match(r"(.*?)://([^/?#]*)([^?#]*)", url or "", re.S)
    if not found:
        return "", ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[2])
    return host, found[3]


def listed(host, path):
    fits = []
    for verdict, rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


def pages_of(spark, urls):
    rows = [(i if i % 7 else None, u, f"page {i}", "clash", "clash") for i, u in enumerate(urls)]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, tokens string, verdict string"
    )


def no_labels(spark):
    return spark.createDataFrame([], "url string, unwanted boolean")


def test_listed_rules(spark):
    found = url_filter.judge_urls(pages_of(spark, URLS * 2), no_labels(spark)).collect()
    wanted = Counter()
    for i, url in enumerate(URLS * 2):
        host, path = parts(url)
        rule, verdict = listed(host, path)
        wanted[i if i % 7 else None, host, path, rule, verdict or "allow", 0, None] += 1
    assert Counter(map(tuple, found)) == wanted


def test_empty_tables(spark):
    none = url_filter.judge_urls(pages_of(spark, []), no_labels(spark))
    assert none.count() == 0
    assert none.columns == ["page_id", "host", "path", "rule", "verdict", "n_mined", "mined"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.labelled_urls(pages_of(spark, URLS), labels).count() == 0


def test_labels_of_pages(spark):
    pages = pages_of(
        spark, ["http://a.com/en/1", "http://a.com/en/2.html?x", "http://a.com/3/", "http://a.com/b4", None]
    )
    labels = spark.createDataFrame(
        [(1, 0, 0), (1, 1, 0), (2, 1, 0), (2, None, None), (3, 1, 1), (4, 0, 0), (None, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    found = url_filter.labelled_urls(pages, labels).collect()
    assert {(r["url"], r["unwanted"]) for r in found} == {
        ("http://a.com/en/1", True), ("http://a.com/en/2.html?x", False), ("http://a.com/3/", True)
    }


def labelled_rows():
    """Unwanted: shop pages with a price parameter, and all of one host."""
    rows = []
    for i in range(60):
        shop, priced, host = i % 2, i % 3 == 0, ("a", "b", "c", "spam")[i % 4]
        url = f"http://{host}.com/{'shop' if shop else 'news'}/{i}" + ("?price=1" if priced else "")
        rows.append((url, bool(shop and priced) or host == "spam"))
    return [*rows, (None, True), ("", True), (rows[0][0], None)]


def by_all_combinations(tokens, labels, least, confidence):
    """The minimal rules, from the count of every combination."""
    seen, bad = Counter(), Counter()
    for t, unwanted in zip(tokens, labels, strict=True):
        for c in chain.from_iterable(combinations(t, n) for n in range(1, len(t) + 1)):
            seen[c] += 1
            bad[c] += bool(unwanted)
    rules = {c for c in seen if bad[c] >= least and bad[c] / seen[c] >= confidence}
    return {c for c in rules if not any(set(r) < set(c) for r in rules)}


@pytest.mark.parametrize(("support", "confidence"), [(0.05, 0.5), (0.02, 0.9), (0.2, 0.7)])
def test_rules_are_those_of_all_combinations(spark, support, confidence):
    rows = labelled_rows()
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    tokens = [
        r[0] for r in labelled.select(url_filter.tokens_of(labelled["url"])).collect()
    ]
    assert tokens[0] == ["host:0.com", "host:1.a", "path:0", "path:news", "query:price", "scheme:http"]
    total = sum(bool(t) for t in tokens)
    least = max(-int(-support * total // 1), 2)
    wanted = by_all_combinations(tokens, [r[1] for r in rows], least, confidence)
    found = url_filter.mine_rules(labelled, support, confidence).collect()
    assert {tuple(r["tokens"]) for r in found} == wanted
    assert len(found) == len(wanted)
    for r in found:
        with_them = [b for t, (_, b) in zip(tokens, rows, strict=True) if set(r["tokens"]) <= set(t)]
        assert r["confidence"] == pytest.approx(sum(map(bool, with_them)) / len(with_them))


def test_mined_rules_judge_what_no_listed_rule_fits(spark):
    labelled = spark.createDataFrame(labelled_rows(), "url string, unwanted boolean")
    rules = [set(r["tokens"]) for r in url_filter.mine_rules(labelled, 0.05, 0.9).collect()]
    assert {"host:1.spam"} in rules
    urls = ["http://spam.com/news/1", "https://d.com/shop/7?price=2&x", "http://spam.com/de/1",
            "http://d.com/news/7?price=2", "http://example.net/en/shop?price=1", None]
    pages = pages_of(spark, urls).withColumnRenamed("html", "n_mined")
    found = url_filter.judge_urls(pages, labelled, support=0.05, confidence=0.9)
    by_url = {(r["host"], r["path"]): r for r in found.collect()}
    verdicts = {k: v["verdict"] for k, v in by_url.items()}
    assert verdicts == {
        ("spam.com", "/news/1"): "block", ("d.com", "/shop/7"): "block",
        ("spam.com", "/de/1"): "block", ("d.com", "/news/7"): "allow",
        ("example.net", "/en/shop"): "allow", ("", ""): "allow",
    }
    assert by_url["example.net", "/en/shop"]["n_mined"] > 0
    tokens = pages.select(url_filter.tokens_of(pages["url"]).alias("t"), "url").collect()
    for r in tokens:
        matched = sum(rule <= set(r["t"]) for rule in rules)
        assert by_url[parts(r["url"])]["n_mined"] == matched


def test_urls_of_many_tokens_are_not_learned_from(spark):
    many = "http://a.com/" + "/".join(f"part{chr(97 + i)}" for i in range(20))
    labelled = spark.createDataFrame(
        [(many, True)] * 5 + [("http://b.com/x", True)] * 3, "url string, unwanted boolean"
    )
    found = url_filter.mine_rules(labelled, 0.1, 0.5).collect()
    # Tokens that both have are counted with those that are learned from only.
    assert all(not t.startswith("path:part") for r in found for t in r["tokens"])
    assert ["host:1.b"] in [r["tokens"] for r in found]


def test_urls_of_many_tokens_are_learned_from(spark):
    names = [f"part{chr(97 + i)}" for i in range(24)]
    rows = [("http://a.com/" + "/".join(names), i % 2 == 0) for i in range(9)]
    rows += [("http://a.com/" + "/".join([*names[:-1], "other"]), False)] * 9
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    pages = pages_of(spark, [rows[0][0], rows[-1][0]])
    found = url_filter.judge_urls(pages, labelled, support=0.1).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["verdict"], r["n_mined"], r["mined"]) for r in found} == {
        ("partx", "block", 1, "path:partx"), ("other", "allow", 0, None)
    }


def test_no_bound_on_tokens_gives_all_minimal_rules(spark):
    names = [f"p{chr(97 + i)}" for i in range(11)]
    rows = []
    for i in range(48):
        some = [n for k, n in enumerate(names) if (i * (k + 3) + k) % (k + 2)]
        rows.append(("http://a.com/" + "/".join(some), {"pb", "pc", "pe"} <= set(some)))
    labelled = spark.createDataFrame(rows, "url string, unwanted boolean")
    tokens = [r[0] for r in labelled.select(url_filter.tokens_of(labelled["url"])).collect()]
    assert max(map(len, tokens)) > 12
    for least, confidence in ((4, 0.5), (3, 0.6)):
        wanted = by_all_combinations(tokens, [r[1] for r in rows], least, confidence)
        found = url_filter.mine_rules(labelled, least / 48, confidence, most_tokens=None).collect()
        assert wanted and sorted(tuple(r["tokens"]) for r in found) == sorted(wanted)


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_sql(spark, sf_dir):
    found = queries.op13_url_filter(spark, sf_dir)
    assert differences(found, connect(sf_dir), oracle.ORACLE_SQL["op13_url_filter"]) == ""
