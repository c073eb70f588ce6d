"""Mixing sources to target weights.

Method: Pareto order sampling with unequal probabilities. Within a source longer documents are
preferred: those of a size class have ``min(most, rate * weight of the class)`` expected copies, and
the source's rate is the one at which the expected words are its target. The whole part is certain:
every document gets that many copies. The rest, f, is an inclusion probability of its class:
documents are ranked by odds(u) / odds(f), u being uniform by a hash of the document, and the sample
is fixed in size: it takes documents of all classes in rank order as long as their words fit the
rest of the target, and then the largest document that still fits.
The place where a source's sample ends is found by histograms of the ranks, 256 times finer at
each of three levels, so that no task sorts a source.

Targets: sources in code point order, null last, weigh ``weights`` in turn, repeating, and share
``budget`` times all words; a target stops at ``most`` times its source's words and the excess is
shared again by weight.

Everything is DataFrame expressions. Defined results: a null text has size 0; rows of one source
and size class with the same id (or without one) are taken or left together; documents of size 0 get the whole
copies, and the sampled one if they rank before the end; a source of size 0 has target 0 and no
copies; empty tables give no rows; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.llm.common import WHITE
from delaylake.operators.ordering import running_before
from delaylake.workspace import written

#: Fixed values.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0

#: Size classes start at these words, and their documents' expected copies are as these weights.
CLASS_STARTS = (0, 64, 512)
CLASS_WEIGHTS = (2.0, 3.0, 4.0)

SEED = "mix-1"
DIGITS = 256
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    return sum((size >= start).cast("int") for start in CLASS_STARTS[1:])


def source_key(source: Column) -> Column:
    """Tells a null source from an empty one, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / float(1 << 52)


def targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST
) -> DataFrame:
    """Per source: key, source_size, target."""
    sources = written(
        sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size")), "sources"
    )
    in_order = [F.col("source").isNull(), F.col("source")]
    numbered = running_before(
        sources.withColumns({"_o0": in_order[0], "_o1": in_order[1]}),
        ["_o0", "_o1"], F.lit(1), "number",
    )
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = written(
        numbered.select(
            "key", "source_size", turn.alias("weight"),
            (F.lit(most) * F.col("source_size") / turn).alias("full_at"),
        ),
        "weighed",
    )
    total, weight = weighed.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    # A unit of weight gets as much as it would if just the sources before were full.
    before = running_before(weighed, ["full_at", "key"], F.col("source_size"), "size_before")
    before = running_before(before, ["full_at", "key"], F.col("weight"), "weight_before")
    unit = (budget * total - F.lit(most) * F.col("size_before")) / (weight - F.col("weight_before"))
    level = (
        before.withColumn("unit", unit)
        .where("unit <= full_at")
        .agg(F.min_by("unit", F.struct("full_at", "key")))
        .first()[0]
    )
    full = F.lit(most) * F.col("source_size")
    share = full if level is None else F.least(full, F.lit(level) * F.col("weight"))
    return weighed.select("key", "source_size", share.alias("target"))


def expected_copies(words: list[Column], target: Column, most: float) -> Column:
    """Of a document of each class, as an array, from the source's words by class and its target.

    The classes of most weight reach ``most`` first; the rate is the first one that holds for the
    others with those before them full."""
    order = sorted(range(len(words)), key=lambda c: -CLASS_WEIGHTS[c])
    rates = []
    for j, c in enumerate(order):
        full = reduce(add, (words[i] for i in order[:j]), F.lit(0))
        left = reduce(add, (words[i] * CLASS_WEIGHTS[i] for i in order[j:]))
        rate = (target - F.lit(most) * full) / F.nullif(left, F.lit(0.0))
        rates.append(F.when(rate * CLASS_WEIGHTS[c] <= most, rate))
    rate = F.coalesce(*rates)
    return F.array(*[F.coalesce(F.least(F.lit(most), rate * w), F.lit(most)) for w in CLASS_WEIGHTS])


def _rest(size_class: Column) -> Column:
    """The probability of one more copy than the certain ones."""
    expected = F.get("expected", size_class)
    return expected - F.floor(expected)


def plan(sizes: DataFrame, **options) -> DataFrame:
    """Per source: key, source_size, target, the ``expected`` copies by class, and the sample: up to
    (``last_rank``, ``last_doc``, ``last_class``), and those of ``extra``."""
    most = options.get("most", MOST)
    classes = range(len(CLASS_STARTS))
    by_class = sizes.groupBy("key").agg(
        *[
            F.sum(F.when(F.col("class") == c, F.col("size")).otherwise(0)).alias(f"words_{c}")
            for c in classes
        ]
    )
    words = [F.col(f"words_{c}") for c in classes]
    nothing = F.array(*[F.lit(0.0) for _ in classes])
    expected = expected_copies(words, F.col("target"), most)
    certain = reduce(add, (F.floor(F.col("expected")[c]) * words[c] for c in classes))
    sources = written(
        targets(sizes, **options)
        .join(by_class, "key")
        .withColumn("expected", F.when(F.col("source_size") > 0, expected).otherwise(nothing))
        .withColumn("room", F.col("target") - certain)
        .select("key", "source_size", "target", "expected", "room"),
        "plan",
    )
    sampled = sources.where(F.exists("expected", lambda e: e > F.floor(e)))
    docs = written(
        sizes.groupBy("key", "doc_id", "class")
        .agg(F.sum("size").alias("words"))
        .join(sampled.select("key", "expected"), "key")
        .withColumn("rest", _rest(F.col("class")))
        .where("rest > 0")
        .select(
            "key", "doc_id", "class", "words", rank(F.col("doc_id"), F.col("rest")).alias("rank")
        ),
        "ranks",
    )
    ends = sampled.select(
        "key", "room", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before")
    )
    for level in range(1, LEVELS + 1):
        ends = _refined(docs, ends, level)
    in_last = docs.join(ends, "key").where(_bucket(LEVELS) == F.col("bucket"))
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "class")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = in_last.withColumn("words_to", F.col("before") + F.sum("words").over(up_to)).where(
        "words_to <= room"
    )
    last = fit.groupBy("key").agg(
        F.max(F.struct("rank", "doc_id", "class")).alias("last"),
        F.max("words_to").alias("words_to")
    )
    ends = written(
        ends.join(last, "key", "left").select(
            "key", "room", "bucket",
            F.coalesce("words_to", "before").alias("words_to"),
            F.col("last")["rank"].alias("last_rank"),
            F.col("last")["doc_id"].alias("last_doc"),
            F.col("last")["class"].alias("last_class"),
        ),
        "ends",
    )
    left = docs.join(ends, "key").where(
        ~_sampled() & (F.col("words") > 0) & (F.col("words") <= F.col("room") - F.col("words_to"))
    )
    extra = left.groupBy("key").agg(
        F.max(
            F.struct(
                "words", (-F.col("rank")).alias("r"), (-F.col("doc_id")).alias("d"),
                (-F.col("class")).alias("c"),
            )
        ).alias("extra")
    )
    return written(
        sources.drop("room")
        .join(ends.drop("room", "words_to"), "key", "left")
        .join(
            extra.select(
                "key",
                F.struct((-F.col("extra.d")).alias("doc_id"), (-F.col("extra.c")).alias("class"))
                .alias("extra"),
            ),
            "key", "left",
        ),
        "mix",
    )


def rank(doc_id: Column, probability: Column) -> Column:
    """odds(u) / odds(probability), as a number in (0, 1) of the same order."""
    u = uniform(doc_id)
    odds = (u / (1 - u)) * ((1 - probability) / probability)
    return odds / (1 + odds)


def _bucket(level: int) -> Column:
    return F.floor(F.col("rank") * float(DIGITS**level))


def _refined(docs: DataFrame, ends: DataFrame, level: int) -> DataFrame:
    """Of the DIGITS parts of each source's bucket, the one where its sample ends."""
    inside = docs.join(ends, "key").where(_bucket(level - 1) == F.col("bucket"))
    parts = inside.groupBy("key", "room", "before", _bucket(level).alias("part")).agg(
        F.sum("words").alias("words")
    )
    order = Window.partitionBy("key").orderBy("part")
    words_to = F.col("before") + F.sum("words").over(order)
    found = (
        parts.withColumn("words_to", words_to)
        .groupBy("key", "room", "before")
        .agg(
            F.min(F.when(F.col("words_to") > F.col("room"), F.col("part"))).alias("end"),
            F.max(F.when(F.col("words_to") <= F.col("room"), F.col("words_to"))).alias("fit"),
            F.max("part").alias("highest"),
        )
    )
    return written(
        found.select(
            "key", "room",
            F.coalesce("end", F.col("highest") + 1).alias("bucket"),
            F.coalesce("fit", "before").alias("before"),
        ),
        "ends",
    )


def _sampled() -> Column:
    """Whether (rank, doc_id, class) is in the sample, the extra document aside."""
    last = F.struct("last_rank", "last_doc", "last_class")
    in_order = F.struct(F.col("rank"), F.col("doc_id"), F.col("class")) <= last
    part = _bucket(LEVELS)
    return F.coalesce(
        (part < F.col("bucket")) | (F.col("last_rank").isNotNull() & in_order), F.lit(False)
    )


def copies_taken() -> Column:
    """Copies of a document, from the columns of ``_joined``."""
    is_extra = (F.col("extra.doc_id") == F.col("doc_id")) & (F.col("extra.class") == F.col("class"))
    sampled = _sampled() | F.coalesce(is_extra, F.lit(False))
    more = F.when(F.col("rest") > 0, sampled.cast("long")).otherwise(0)
    return F.coalesce(F.floor(F.get("expected", F.col("class"))), F.lit(0)) + more


def _joined(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows with their source's plan, ``rest`` and rank."""
    both = sizes.join(planned, "key", "left").withColumn("rest", _rest(F.col("class")))
    return both.withColumn(
        "rank", F.when(F.col("rest") > 0, rank(F.col("doc_id"), F.col("rest")))
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"),
    ).withColumn("class", size_class(F.col("size")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, source_size, target and the words that the mix takes."""
    sizes = written(sizes_of(docs), "sizes")
    planned = plan(sizes, **options)
    return _joined(sizes, planned).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies_taken() * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their columns."""
    planned = plan(written(sizes_of(docs), "sizes"), **options)
    wrapped = docs.select(
        "doc_id", source_key(F.col("source")).alias("key"),
        size_class(word_count(F.col("text"))).alias("class"), F.struct(*docs.columns).alias("_doc"),
    )
    times = F.sequence(F.lit(1).cast("long"), copies_taken())
    return (
        _joined(wrapped, planned)
        .where(copies_taken() > 0)
        .select("_doc", F.explode(times).alias("_copy"))
        .select("_doc.*")
    )
