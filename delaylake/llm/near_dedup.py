"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

Method: BagMinHash. A document is a bag of shingles of five words. Its weights are discretised
to whole numbers, cut into the levels [0, 1), [1, 2), [2, 4), [4, 8) and so on. Every shingle and
level is a Poisson process whose points come in order of time, each with a random register and a
random place in its level; a point counts if its place lies below the bag's weight, so a lighter
bag has a part of the heavier one's points. A register holds the earliest point that falls on
it; two bags agree in a register with the probability of their weighted Jaccard similarity. Points
are only made up to the time by which all registers are full.

Registers are banded. Documents that share a band are candidates: texts with the same words are
one node; in rounds, each node is compared with the node of another class that is the centre of
most of its bands, and what is similar becomes one class, until a round finds little. Then all
nodes of one band that are still in different classes are compared, if their bags' sizes allow
for the threshold and their registers agree as often as it makes likely (all but 2.8e-6). So the
members of a large group of copies are compared with its centres and not with each other. Where
a band still has many nodes of different classes, those outside of its largest class are laid out
in tiles against all of the band: each tile is compared in one task and gives its links only. A
comparison counts the bags' overlap exactly. Classes are the connected components of what is
similar enough. With ``BANDS`` bands of ``ROWS`` registers a pair at 0.8 shares none with probability
7e-5.

Defined results: a null text is an empty one; all texts without words are one class; texts of
fewer than five words are one shingle; white space does not matter; repeated rows and ids are
documents of their own; null ids come last in a class; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm.common import arrow_schema, map_batches, to_batch
from delaylake.llm.components import components
from delaylake.llm.word_hashes import GOLDEN, U64, chunks, mix, shingles, stream, words
from delaylake.workspace import written

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Registers that agree at least, of a pair at LEAST: 96 expected, less 4.8 deviations.
AGREEING = 75
#: The rounds end when less than one pair in so many is similar, and bands with more pairs to
#: compare than that are compared in tiles.
FEW = 100
#: Nodes of one side of a tile: what a task holds.
TILE = 256


def bags(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, shingle and weight of each distinct shingle of each text, in this order."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    first = np.ones(len(text), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from 53 bits."""
    return ((x >> U64(11)).astype(np.float64) + 1) / float(1 << 53)


def processes(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple:
    """The levels that each weight reaches: text, seed, rate, and the share of it below the
    weight."""
    levels = stream(65, 3)
    out = [(text, mix(shingle ^ levels[0]), np.ones(len(text)), np.ones(len(text)))]
    low, level = 1, 1
    while True:
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))
        share = np.minimum((weight[reach] - low) / low, 1.0)
        seed = mix(shingle[reach] ^ levels[level])
        out.append((text[reach], seed, np.full(len(reach), float(low)), share))
        low, level = 2 * low, level + 1


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of registers for each text; those of a text without shingles stay 0."""
    n, m = len(counts), REGISTERS
    best = np.full(n * m, np.inf)
    winner = np.zeros(n * m, dtype=np.uint64)
    text, seed, rate, share = processes(*bags(hashes, counts))
    # All registers are full by then, but for one text in 150; those go on for longer.
    until = m * (np.log(m) + 5) / np.maximum(counts, 1)
    at = np.zeros(len(text))
    point = np.zeros(len(text), dtype=np.uint64)
    while len(text):
        waiting = []
        while len(text):
            with np.errstate(over="ignore"):
                point = point + U64(1)
                draw = mix(seed + point * GOLDEN)
                later = at - np.log(uniform(draw)) / rate
                on = later <= until[text]
                if not on.all():
                    off = ~on
                    waiting.append(
                        (text[off], seed[off], rate[off], share[off], at[off], point[off] - U64(1))
                    )
                    text, seed, rate, share, point, later, draw = (
                        x[on] for x in (text, seed, rate, share, point, later, draw)
                    )
                at = later
                draw = mix(draw + GOLDEN)
                place = uniform(mix(draw + GOLDEN)) <= share
            register = (draw % U64(m)).astype(np.int64) + text * m
            hit, time, name = register[place], at[place], draw[place]
            np.minimum.at(best, hit, time)
            mine = best[hit] == time
            winner[hit[mine]] = name[mine]
        unfilled = np.isinf(best).reshape(n, m).any(axis=1) & (counts > 0)
        if not unfilled.any() or not waiting:
            break
        until = until * 2
        parts = [np.concatenate(x) for x in zip(*waiting, strict=True)]
        go = unfilled[parts[0]]
        text, seed, rate, share, at, point = (x[go] for x in parts)
    return winner.reshape(n, m)


def same_words(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two numbers for each text that tell its words and their order."""
    ends = np.cumsum(counts)
    place = np.arange(len(hashes)) - np.repeat(ends - counts, counts)
    out = []
    with np.errstate(over="ignore"):
        for seed in stream(2, 4):
            each = mix(hashes ^ mix((place.astype(np.uint64) + U64(1)) * GOLDEN + seed))
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(each, dtype=np.uint64)])
            out.append(mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)))
    return out


def sign(docs: DataFrame) -> DataFrame:
    """_row, doc_id, the key of the words, the bands' hashes and 16 bits of each register."""
    keys = stream(ROWS, 5) | U64(1)

    def work(batch: pa.RecordBatch):
        for first, data, at in chunks(batch.column("text")):
            hashes, counts, _, _ = words(data, at)
            one, two = same_words(hashes, counts)
            runs, sizes = shingles(hashes, counts, SHINGLE)
            found = signatures(runs, sizes)
            with np.errstate(over="ignore"):
                bands = mix((found.reshape(-1, BANDS, ROWS) * keys).sum(axis=2, dtype=np.uint64))
            size = len(counts)
            offsets = np.arange(size + 1, dtype=np.int32)
            digits = (found & U64(0xFFFF)).astype(np.uint16).view(np.int16)
            yield {
                "_row": batch.column("_row").slice(first, size),
                "doc_id": batch.column("doc_id").slice(first, size),
                "one": one.view(np.int64),
                "two": two.view(np.int64),
                "size": sizes,
                "bands": pa.ListArray.from_arrays(offsets * BANDS, bands.ravel().view(np.int64)),
                "registers": pa.ListArray.from_arrays(offsets * REGISTERS, digits.ravel()),
            }

    return map_batches(
        docs.select("_row", "doc_id", F.coalesce("text", F.lit("")).alias("text")),
        work,
        "_row long, doc_id long, one long, two long, size long, bands array<long>, "
        "registers array<short>",
    )


def _overlaps(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text: sorted shingles and their weights."""
    out = []
    for _, data, at in chunks(texts):
        hashes, counts, _, _ = words(data, at)
        text, shingle, weight = bags(*shingles(hashes, counts, SHINGLE))
        cut = np.searchsorted(text, np.arange(len(counts) + 1))
        out += [
            (shingle[i:j], weight[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)
        ]
    return out


def is_similar(a: tuple, b: tuple) -> bool:
    """Whether the smaller weights sum to at least LEAST of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum()) + int(b[1].sum()) - common
    return common * LEAST[1] >= whole * LEAST[0]


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of rows, those whose texts are similar. A row that is in many pairs is
    joined like any other key, which Spark splits if it is too large for a task."""

    def work(batch: pa.RecordBatch):
        left, right = _overlaps(batch.column("text_a")), _overlaps(batch.column("text_b"))
        keep = pa.array([is_similar(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
        yield {n: batch.column(n).filter(keep) for n in ("a", "b")}

    def named(name: str) -> DataFrame:
        return texts.select(F.col("_row").alias(name), F.col("text").alias(f"text_{name}"))

    both = pairs.join(named("b"), "b").join(named("a"), "a")
    return map_batches(both.select("a", "b", "text_a", "text_b"), work, "a long, b long")


def near_classes(rows: DataFrame) -> DataFrame:
    """_row, doc_id, class_id and is_first of every row of a written table with _row."""
    signed = written(sign(rows), "signatures")
    nodes = written(
        signed.groupBy("one", "two").agg(F.min("_row").alias("node")), "nodes"
    )
    own = signed.join(nodes.select(F.col("node").alias("_row")), "_row").where("size > 0")
    banded = written(
        own.select(
            F.col("_row").alias("node"), "size", F.posexplode("bands").alias("band", "hash")
        ).select("node", "size", F.xxhash64("band", "hash").alias("band")),
        "bands",
    )
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = written(banded.join(sizes, "band"), "shared")
    # The original of many copies shares its bands with more nodes than any copy does.
    weights = written(met.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    shared = written(met.drop("n").join(weights, "node"), "shared")
    texts = rows.select("_row", F.coalesce("text", F.lit("")).alias("text"))
    links = tested = None
    labelled = shared.withColumn("root", F.col("node"))
    for turn in count():
        pairs = written(_stars(labelled, tested, turn), "pairs")
        found = written(similar(pairs, texts), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        n_found = found.count()
        if n_found:
            labelled = _labelled(shared, written(components(links), "components"))
        if n_found * FEW <= pairs.count():
            break
    few, many = _by_cross_pairs(labelled)
    rest = written(_across(few, signed).join(tested, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(similar(rest, texts)).unionByName(_in_tiles(many, signed, texts))
    links = written(links, "links")
    return _with_class(signed, nodes, written(components(links), "components"))


def _labelled(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """The nodes of the bands that hold more than one class so far."""
    rooted = written(
        shared.join(linked, "node", "left").select(
            "band", "node", "size", "weight", F.coalesce("root", "node").alias("root")
        ),
        "labelled",
    )
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = written(mixed.where("low < high").select("band"), "mixed")
    return written(rooted.join(mixed, "band"), "labelled")


def _stars(labelled: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """Each band has two centres: its node of the largest weight, and one that is another in each
    turn. A node is paired with one of another class that is the centre of most of its bands,
    among those it has not been compared with."""
    heavy = F.struct("weight", "root", "node", "size")
    drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("weight"), "root", "node", "size")
    ends = written(
        labelled.groupBy("band").agg(F.array(F.max(heavy), F.max(drawn)).alias("centres")),
        "band_ends",
    )
    met = labelled.join(ends, "band").select(
        "node", "root", "size", F.explode("centres").alias("centre")
    )
    often = (
        met.where(F.col("centre.root") != F.col("root"))
        .where(_sizes_fit(F.col("centre.size"), F.col("size")))
        .groupBy("node", F.col("centre.node").alias("other"))
        .agg(F.count("*").alias("n"))
        .withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")})
    )
    if tested is not None:
        often = often.join(tested, ["a", "b"], "left_anti")
    return (
        often.groupBy("node")
        .agg(F.max(F.struct("n", "a", "b")).alias("best"))
        .select("best.a", "best.b")
        .distinct()
    )


def _sizes_fit(a: Column, b: Column) -> Column:
    """Bags of other sizes cannot overlap enough."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


MEMBER = ("node", "root", "size", "registers")


def _across(labelled: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of a band in different classes so far, whose registers agree often enough."""
    registers = signed.select(F.col("_row").alias("node"), "registers")
    members = written(labelled.join(registers, "node"), "members")
    a, b = (
        members.select("band", *[F.col(c).alias(f"{c}_{s}") for c in MEMBER]) for s in "ab"
    )
    agreeing = F.size(
        F.filter(F.zip_with("registers_a", "registers_b", lambda x, y: x == y), lambda x: x)
    )
    return (
        a.join(b, "band")
        .where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")))
        .where(_sizes_fit(F.col("size_a"), F.col("size_b")) & (agreeing >= AGREEING))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )


def _by_cross_pairs(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bands with up to FEW pairs to compare, and those with more; ``outside`` says that a
    node is not in its band's largest class, ``n_outside`` and ``n`` count those and all."""
    by_root = labelled.groupBy("band", "root").agg(F.count("*").alias("n"))
    largest = by_root.groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("n")
    )
    bands = written(
        largest.select(
            "band", "n", F.col("largest.root").alias("main"),
            (F.col("n") - F.col("largest.n")).alias("n_outside"),
        ),
        "cross_pairs",
    )
    both = written(
        labelled.join(bands, "band").withColumn("outside", F.col("root") != F.col("main")),
        "cross_pairs",
    )
    is_few = F.col("n") * F.col("n_outside") <= FEW
    return both.where(is_few), both.where(~is_few)


def _in_tiles(many: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of nodes outside their band's largest class with any node of the band."""
    schema = "a long, b long"
    arrow = arrow_schema(many.sparkSession, schema)

    def tiles(n: str) -> Column:
        return F.ceil(F.col(n) / TILE)

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), tiles(n) - 1))

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), tiles(n))

    columns = ("band", "i", "j", "query", "node", "root", "size")
    queries = many.where("outside").select(
        "*", own("n_outside").alias("i"), spread("n").alias("j"), F.lit(True).alias("query")
    )
    members = many.select(
        "*", spread("n_outside").alias("i"), own("n").alias("j"), F.lit(False).alias("query")
    )
    # Known of a member besides: whether it is a query too, then a pair of two is met once.
    laid = queries.select(*columns, "outside").unionByName(members.select(*columns, "outside"))
    signs = signed.select(F.col("_row").alias("node"), "bands", "registers")
    full = laid.join(signs, "node").join(texts.withColumnRenamed("_row", "node"), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, size = (table.column(n).to_numpy() for n in ("node", "root", "size"))
        query, outside = (
            table.column(n).to_numpy(zero_copy_only=False) for n in ("query", "outside")
        )
        registers = np.concatenate(
            [c.flatten().to_numpy() for c in table.column("registers").chunks]
        ).reshape(-1, REGISTERS)
        hashes = np.array(table.column("bands").to_pylist(), dtype=np.int64)
        bags_ = _overlaps(pa.concat_arrays(table.column("text").chunks))
        # The place of this band among each node's: pairs are compared in their first one.
        place = _this_band(hashes, query)
        parent = {int(r): int(r) for r in root}

        def top(r: int) -> int:
            while parent[r] != r:
                r = parent[r]
            return r

        out: dict[str, list] = {"a": [], "b": []}
        others = np.flatnonzero(~query)
        for x in np.flatnonzero(query):
            small, large = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
            fit = (small * LEAST[1] >= large * LEAST[0]) & (root[others] != root[x])
            fit &= ~outside[others] | (node[others] > node[x])
            some = others[fit]
            some = some[(registers[some] == registers[x]).sum(axis=1) >= AGREEING]
            shared = hashes[some] == hashes[x]
            some = some[shared.argmax(axis=1) == place]
            for y in some.tolist():
                one, two = top(int(root[x])), top(int(root[y]))
                if one != two and is_similar(bags_[x], bags_[y]):
                    parent[max(one, two)] = min(one, two)
                    out["a"].append(min(node[x], node[y]))
                    out["b"].append(max(node[x], node[y]))
        return pa.Table.from_batches([to_batch(out, arrow)], schema=arrow)

    return full.groupBy("band", "i", "j").applyInArrow(compare, schema)


def _this_band(hashes: np.ndarray, query: np.ndarray) -> int:
    """Which of the bands all rows of a tile have in common with its first query, first of all."""
    if not query.any():
        return 0
    same = (hashes == hashes[np.flatnonzero(query)[0]]).all(axis=0)
    return int(same.argmax())


def _with_class(signed: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    classed = written(
        signed.select("_row", "doc_id", "one", "two")
        .join(nodes, ["one", "two"])
        .join(linked, "node", "left")
        .select("_row", "doc_id", F.coalesce("root", "node").alias("root")),
        "classes",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    firsts = written(classed.groupBy("root").agg(F.min(order).alias("first")), "firsts")
    return classed.join(firsts, "root").select(
        "_row",
        "doc_id",
        F.col("first")["doc_id"].alias("class_id"),
        (F.col("first")["_row"] == F.col("_row")).alias("is_first"),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written so that it stays theirs."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and whether it is the one to keep."""
    return near_classes(numbered(docs.select("doc_id", "text"))).drop("_row")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with its columns."""
    wrapped = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    rows = numbered(wrapped)
    kept = near_classes(rows.select("_row", "doc_id", "text")).where("is_first").select("_row")
    return rows.join(kept, "_row", "left_semi").select("_doc.*")
