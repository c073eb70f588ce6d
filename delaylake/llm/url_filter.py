"""Judging urls by listed rules, and by rules mined from labelled ones.

Method: association rules. A url is a set of tokens: its scheme, the labels of its host by their
place, the parts of its path, its extension, the names of its query's parameters, and whether it
has a fragment; outside the host, digits count by their place and not by what they say. The token
combinations that labelled urls share are counted level by level, by their size; one becomes
a rule if it is frequent enough together with the label and the label follows from it often
enough, and no part of it is a rule already. Only combinations that are rarer than all their parts
go on to the next level. Rules are matched by an inverted index:
each stands under the rarest of its tokens, and is compared with the token sets that hold it.

Listed rules go first: one fits its host and all subdomains if the path starts with the rule's, and
the longest that fits decides.

Defined results: a url that is null or has no ``://`` has an empty host and path; without a label
in the whole table, or without one that is wanted, nothing is mined, and what no listed rule fits
is allowed; repeated rows are judged each; other columns are ignored. Every labelled url is learned
from and every url is judged, by all its tokens. How many combinations there are depends
on the data: tokens that come and go independently of each other still have 2^n.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.workspace import written

#: Share of the labelled urls that must hold a combination together with the label, and share of
#: those with the combination that must have the label.
SUPPORT, CONFIDENCE = 0.005, 0.5
#: However few urls are labelled, a rule does not rest on a single one.
FEWEST = 2
#: For callers of ``mine_rules`` who want a bound on the combinations, 2^MOST_TOKENS / SUPPORT, rather
#: than all rules: frequent tokens of a url that is learned from. ``judge_urls`` sets no such bound.
MOST_TOKENS = 12

#: Listed rules.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def _upper_to_lower(text: Column) -> Column:
    """A to Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _part(url: Column, group: int) -> Column:
    whole = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    return F.coalesce(F.regexp_extract(url, whole, group), F.lit(""))


def host_of(url: Column) -> Column:
    return _upper_to_lower(_part(url, 2))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """verdict and rule of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(
            path, F.lit(slash + rest)
        )
        decided = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, decided).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """The different tokens of a url, in order; none without a host."""

    def marked(kind: str, values: Column) -> Column:
        return F.transform(
            F.filter(values, lambda v: v != ""),
            lambda v: F.concat(F.lit(kind), F.regexp_replace(v, "[0-9]+", "0")),
        )

    host, path, query = host_of(url), path_of(url), _part(url, 4)
    labels = F.reverse(F.split(host, r"\."))
    # The place of a host's label counts from its end.
    placed = F.transform(
        labels,
        lambda v, i: F.when(v != "", F.concat(F.lit("host:"), i.cast("string"), F.lit("."), v)),
    )
    last = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(last, r"\.([^.]*)\z", 1)
    folders = F.split(F.regexp_replace(path, r"\.[^./]*\z", ""), "/")
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    fragment = F.when(_part(url, 5) != "", F.array(F.lit("#"))).otherwise(
        F.array().cast("array<string>")
    )
    whole = F.concat(
        marked("scheme:", F.array(_upper_to_lower(_part(url, 1)))),
        F.filter(placed, lambda v: v.isNotNull()),
        marked("path:", folders),
        marked("type:", F.array(extension)),
        marked("query:", names),
        fragment,
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(whole))
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and whether it is unwanted, of the pages that show a labelled document: the number of
    the document is the name of the page. Poor and toxic documents are unwanted, also where a
    document has several labels and one says so."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[^./]*)?/?$", 1)
    said = (F.col("quality") == 0) | (F.col("toxic") == 1)
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(said).alias("unwanted"))
    shown = pages.select("url", number.try_cast("long").alias("doc_id"))
    return shown.join(bad.where("unwanted is not null"), "doc_id").select("url", "unwanted")


def mine_rules(
    labelled: DataFrame,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    most_tokens: int | None = MOST_TOKENS,
) -> DataFrame:
    """tokens, support and confidence of the rules for unwanted urls, without those of which a part
    is a rule. ``labelled`` has url and unwanted. With ``most_tokens`` a url of more frequent tokens
    is not learned from; with None all are."""
    shown = labelled.select(tokens_of(F.col("url")).alias("tokens"), "unwanted")
    sets = written(shown.where(F.size("tokens") > 0), "labelled_urls")
    total = sets.count()
    least = max(math.ceil(support * total), FEWEST)
    # A combination is no more frequent than its tokens, so the others need not be looked at.
    frequent = (
        sets.select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .count()
        .where(F.col("count") >= least)
    )
    numbered = sets.withColumn("row", F.monotonically_increasing_id())
    kept = (
        numbered.select("row", "unwanted", F.explode("tokens").alias("token"))
        .join(frequent.select("token"), "token")
        .groupBy("row", "unwanted")
        .agg(F.array_sort(F.collect_list("token")).alias("kept"))
    )
    if most_tokens is not None:
        kept = kept.where(F.size("kept") <= most_tokens)
    # Many urls have the same tokens; each set is looked at once.
    different = kept.groupBy("kept").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unwanted").alias("bad")
    )
    held = written(
        different.withColumn("set", F.monotonically_increasing_id()), "url_sets"
    )
    learned = held.agg(F.sum("n")).first()[0]
    found = _level_wise(held, least, confidence)
    return found.select(
        "tokens", (F.col("bad") / learned).alias("support"),
        (F.col("bad") / F.col("n")).alias("confidence"),
    )


def _level_wise(sets: DataFrame, least: int, confidence: float) -> DataFrame:
    """tokens, n and bad of the minimal rules of ``sets`` (set, kept, n, bad).

    Combinations grow by a token a step. One goes on if it is frequent enough with the label, is no
    rule yet, and is rarer than each of its parts: a rule as frequent as one of its parts is
    not minimal, the part being a rule too. All parts of a minimal rule go on, so
    none is missed. No step is held by the driver or one task.
    """
    occurs = sets.select("set", "n", "bad", F.transform("kept", lambda t: F.array(t)).alias("all"))
    occurs = occurs.select("set", "n", "bad", F.explode("all").alias("tokens"))
    rules = going_on = None
    while True:
        counted = occurs.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        counted = counted.where(F.col("bad") >= least)
        if going_on is not None:
            counted = _rarer_than_parts(counted, going_on)
        is_rule = F.col("bad") / F.col("n") >= confidence
        counted = written(counted.withColumn("is_rule", is_rule), "url_combinations")
        new = counted.where("is_rule").drop("is_rule")
        rules = new if rules is None else rules.unionByName(new)
        going_on = counted.where(~F.col("is_rule")).select("tokens", "n")
        if going_on.isEmpty():
            return rules
        # Two of a set that differ in their last token make one of the next step.
        size = F.size("tokens")
        ends = written(
            occurs.join(going_on.select("tokens"), "tokens").select(
                "set", "n", "bad", F.slice("tokens", F.lit(1), size - 1).alias("begin"),
                F.element_at("tokens", -1).alias("last"),
            ),
            "url_combinations",
        )
        others = ends.select("set", "begin", F.col("last").alias("next"))
        occurs = (
            ends.join(others, ["set", "begin"])
            .where(F.col("last") < F.col("next"))
            .select("set", "n", "bad", F.concat("begin", F.array("last", "next")).alias("tokens"))
        )
        occurs = written(occurs, "url_combinations")


def _rarer_than_parts(counted: DataFrame, going_on: DataFrame) -> DataFrame:
    """The combinations all of whose parts of a token less go on and are more frequent."""
    parts = counted.select(
        "*", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("part")
    )
    known = going_on.select(F.col("tokens").alias("part"), F.col("n").alias("n_part"))
    return (
        parts.join(known, "part")
        .where(F.col("n") < F.col("n_part"))
        .groupBy("tokens", "n", "bad")
        .agg(F.count(F.lit(1)).alias("parts"))
        .where(F.col("parts") == F.size("tokens"))
        .drop("parts")
    )


def _matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """set, rule and the rule's tokens wherever these are all in the set's. The index has each rule
    under the rarest of its tokens."""
    held = sets.select("set", F.explode("tokens").alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = (
        rules.select("rule", F.col("tokens").alias("needed"), F.explode("tokens").alias("token"))
        .join(often, "token", "left")
        .groupBy("rule", "needed")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    )
    met = held.join(posted, "token").join(sets, "set")
    whole = F.size(F.array_except("needed", "tokens")) == 0
    return met.where(whole).select("set", "rule", "needed")


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **mining
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; n_mined and mined tell how many mined rules
    match its url, and name the first. Rules are learned from all labelled urls."""
    url = F.col("url")
    shown = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        tokens_of(url).alias("tokens"),
    )
    judged = written(shown, "url_tokens")
    # Many urls have the same tokens; each set is matched once.
    different = judged.select("tokens").distinct()
    sets = written(different.withColumn("set", F.monotonically_increasing_id()), "token_sets")
    rows = mine_rules(labelled, **{"most_tokens": None} | mining)
    mined = written(rows.withColumn("rule", F.monotonically_increasing_id()), "mined_rules")
    hits = (
        _matches(sets, mined)
        .groupBy("set")
        .agg(
            F.count(F.lit(1)).alias("n_mined"), F.min(F.array_join("needed", " ")).alias("mined")
        )
        .join(sets, "set")
        .select("tokens", "n_mined", "mined")
    )
    given = listed_rule(F.col("host"), F.col("path"), rules)
    by_mined = F.when(F.col("n_mined").isNotNull(), "block").otherwise("allow")
    return (
        judged.join(hits, "tokens", "left")
        .withColumn("given", given)
        .select(
            "page_id", "host", "path", F.col("given.rule").alias("rule"),
            F.coalesce("given.verdict", by_mined).alias("verdict"),
            F.coalesce("n_mined", F.lit(0)).alias("n_mined"), "mined",
        )
    )
