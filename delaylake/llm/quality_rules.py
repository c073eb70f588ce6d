"""Quality rules whose cutoffs have a bounded risk of rejecting good documents.

Method: every rule is a ratio of the text that is high for poor texts. For each stratum
(language) and rule, labelled good documents are the holdout: a cutoff that would reject k of
its n good documents is certified when P(Binomial(n, risk) <= k) is at most
``delta / (strata * rules * cutoffs)``, which says that the exact upper bound of the share of
good documents it rejects lies under ``risk``; the division makes that hold for all tests
together. The lowest certified cutoff of a rule is used. A rule without one rejects nothing in
its stratum. All rules together reject at most the share ``len(rules) * risk`` of the good
documents of any stratum, with probability 1 - delta.

Everything is DataFrame expressions. Windows of words are compared by 64-bit hashes within one
text; for a text of a million windows the chance of a false repeat is below 1e-7.

Defined results: a null text has no words and fails the base rules; a null language is a stratum
of its own together with the empty one; a document that is labelled more than once is good if all
its labels say so, and null labels do not count; repeated rows are judged alike; without labels
only the base rules reject; other columns are left alone.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm.common import WHITE, let
from delaylake.workspace import written

WHITE_CHARS = " \t\n\x0b\x0c\r"
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
SPAN = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

RISK = 0.004
DELTA = 0.05

#: Name of a ratio, and the cutoffs that are tried for it.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3),
    "dup_lines": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeats": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.18),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 40.0, 100.0),
}


def words_of(text: Column) -> Column:
    """The words; a text without any gives an empty array."""
    inner = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, f"[{WHITE}]+")
    )


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words that lie in a window of ``span`` words found twice or more in the text."""

    def window_hashes(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - span),
            lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(span)]),
        )

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: covered(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                p,
                                lambda x, j: F.struct(
                                    x["i"].alias("i"),
                                    (
                                        F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False))
                                        | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))
                                    ).alias("again"),
                                ),
                            ),
                            lambda x: x["again"],
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(-span).alias("last"), F.lit(0).alias("n")),
            lambda a, s: F.struct(
                s.alias("last"), (a["n"] + F.least(F.lit(span), s - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        return F.when(F.size(w) <= span, F.lit(0)).otherwise(
            let(
                window_hashes(w),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                    marked(h)
                ),
            )
        )

    return let(words, counted)


def measures(text: Column) -> Column:
    """All counts of a text in one struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0
    )
    dense = F.length(F.translate(text, WHITE_CHARS, ""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        )

    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        dense.alias("word_chars"),
        symbols.alias("n_symbols"),
    )


def base_failed(m: Column) -> Column:
    words, again = m["w"]["n_words"], m["w"]["n_repeat_words"]
    return (words < LEAST_WORDS) | (100 * again > MOST_REPEATED_PERCENT * words)


def ratios(m: Column) -> dict[str, Column]:
    """The rules' ratios; 0 where there is nothing to divide by."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return {
        "symbols": share(m["n_symbols"], m["word_chars"]),
        "dup_lines": share(m["l"]["n_dup_lines"], m["l"]["n_lines"]),
        "repeats": share(m["w"]["n_repeat_words"], m["w"]["n_words"]),
        "word_length": share(m["word_chars"], m["w"]["n_words"]),
    }


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def log_gamma(x: Column) -> Column:
    """Of x >= 1: the series for large arguments, at x + 8, and back by the recurrence."""
    y = x + 8
    series = (
        (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    )
    return series - reduce(lambda a, b: a + b, [F.log(x + i) for i in range(8)])


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p: the probability of k itself times the sum of the
    ratios to it, downwards; beyond 60 standard deviations of k they are 0 in a double."""
    k, n = k.cast("double"), n.cast("double")
    log_of_k = (
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    terms = F.least(k, 60 * F.sqrt(k) + 100).cast("long")
    total = F.aggregate(
        F.when(terms < 1, F.array().cast("array<bigint>")).otherwise(
            F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)))
        ),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(
            a["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p),
            lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_of_k) * total)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """Per stratum a struct of the lowest certified cutoff of each rule, null if there is none.

    ``measured`` has doc_id, stratum and m; ``labels`` has doc_id and quality."""
    good = (
        labels.where(F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .where("_quality = 1")
        .select("doc_id")
    )
    held = measured.join(good, "doc_id").where(~base_failed(F.col("m")))
    rejected = [
        F.count_if(value > cutoff).alias(f"{rule}_{i}")
        for rule, value in ratios(F.col("m")).items()
        for i, cutoff in enumerate(RULES[rule])
    ]
    counts = written(
        held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected), "holdout"
    )
    tests = max(counts.count(), 1) * sum(map(len, RULES.values()))

    def lowest(rule: str, cutoffs: tuple[float, ...]) -> Column:
        tried = F.array(
            *[
                F.struct(F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
                for i, c in enumerate(cutoffs)
            ]
        )
        certified = F.filter(
            tried, lambda t: binomial_at_most(t["k"], F.col("n"), risk) <= delta / tests
        )
        return F.get(certified, F.lit(0))["cutoff"].alias(rule)

    return counts.select(
        "stratum", F.struct(*[lowest(r, c) for r, c in RULES.items()]).alias("cutoffs")
    )


def is_kept(m: Column, cutoffs: Column) -> Column:
    rejects = [F.coalesce(v > cutoffs[r], F.lit(False)) for r, v in ratios(m).items()]
    return ~(base_failed(m) | reduce(lambda a, b: a | b, rejects))


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", stratum().alias("stratum"), measures(F.col("text")).alias("m"))


def judge(
    docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """The counts and the verdict of every document, without its text."""
    measured = written(measure(docs), "measures")
    cutoffs = written(fit_cutoffs(measured, labels, risk, delta), "cutoffs")
    m = F.col("m")
    return measured.join(cutoffs, "stratum", "left").select(
        "doc_id",
        m["w"]["n_words"].cast("long").alias("n_words"),
        m["word_chars"].cast("long").alias("word_chars"),
        m["n_symbols"].cast("long").alias("n_symbols"),
        m["l"]["n_dup_lines"].cast("long").alias("n_dup_lines"),
        m["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
        base_failed(m).alias("base_failed"),
        is_kept(m, F.col("cutoffs")).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """The documents that pass, with their columns."""
    cutoffs = written(fit_cutoffs(measure(docs), labels, risk, delta), "cutoffs")
    wrapped = docs.select(stratum().alias("stratum"), F.struct(*docs.columns).alias("_doc"))
    # In one expression, so that the counts of a text are made once.
    kept = let(measures(F.col("_doc.text")), lambda m: is_kept(m, F.col("cutoffs")))
    return wrapped.join(cutoffs, "stratum", "left").where(kept).select("_doc.*")
