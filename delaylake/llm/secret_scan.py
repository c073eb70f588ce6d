"""Finding credentials in texts.

Method: grammar inference. Fixed patterns find credentials whose format is known; these are the
labelled examples. Their prefix tree's statistically compatible states are merged into one
probabilistic automaton for each kind, and the same is done for ordinary long tokens. All long
tokens of all texts that the patterns do not cover whole are candidates, scored by how much likelier a kind's automaton makes
them than the ordinary one does. Ordinary tokens hold credentials that no pattern knows: the
ordinary automaton is learned again from what it makes clearly likelier than the kinds do, until
that stays the same or for ``ROUNDS`` rounds. A kind's cut is taken from its labelled credentials:
``PART`` of the gain that all but ``QUANTILE`` of those reach that were held out, and
``LEAST_GAIN`` at least. What scores above it is reported as kind ``format``, however many
candidates do.

The automata are fitted on at most ``SAMPLE`` distinct examples of each kind, those with the
smallest hash, and on the first ``LONGEST_EXAMPLE`` characters of each; everything is scanned
and scored whole.

Defined results: a null text is an empty one; spans are code points, the end exclusive; a kind
with fewer than ``FEWEST`` examples is not learned, and without any kind nothing is reported
besides the base spans; with few ordinary tokens their automaton is close to one for which all
characters are as likely; repeated rows are scanned alike; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.llm.automata import Automaton
from delaylake.llm.common import map_batches, text_or_empty
from delaylake.workspace import written

#: The kinds in the order of the report, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")

FOUND = "format"
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{16,}")

SAMPLE = 1500
FEWEST = 20
LONGEST_EXAMPLE = 64
ALPHA = 0.05
#: A kind's cut is this part of the gain that all but ``QUANTILE`` of its labelled credentials
#: reach that were held out: those of other formats gain less than they.
QUANTILE, PART = 0.01, 0.5
LEAST_GAIN = 10.0
ROUNDS = 10


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), in this order."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= ACCESS_LEAST
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """Long tokens that base spans do not cover whole."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        covered = max(m.start(), reach)
        while i < len(base) and base[i][0] < m.end():
            if base[i][0] <= covered:
                covered = max(covered, base[i][2])
            reach = max(reach, base[i][2])
            i += 1
        if covered < m.end():
            out.append((m.start(), m.group()))
    return out


def example(text: str, kind: int, start: int, end: int) -> str:
    """The credential itself, of a base span."""
    return ASSIGN.match(text, start, end).group(2) if kind == 0 else text[start:end]


def scan(docs: DataFrame) -> DataFrame:
    """Per document its base spans, their credentials, and its candidates."""

    def work(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        base = [base_spans(t) for t in texts]
        yield {
            "doc_id": batch.column(0),
            "base": [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base],
            "examples": [
                [{"kind": k, "token": example(t, k, s, e)} for s, k, e in b]
                for t, b in zip(texts, base, strict=True)
            ],
            "candidates": [
                [{"start": s, "token": c} for s, c in candidates(t, b)]
                for t, b in zip(texts, base, strict=True)
            ],
        }

    return map_batches(
        docs.select("doc_id", text_or_empty().alias("text")),
        work,
        "doc_id long, base array<struct<start:long, kind:int, end:long>>, "
        "examples array<struct<kind:int, token:string>>, "
        "candidates array<struct<start:long, token:string>>",
    )


class Scorer:
    """Automata of the kinds and of ordinary tokens, with the gain over these that is enough."""

    def __init__(self, examples: dict[int, list[str]], unlabelled: list[str]):
        labelled = [x for x in examples.values() if len(x) >= FEWEST]
        self.kinds = [_learned(x) for x in labelled]
        self.ordinary = Automaton()
        self.cuts: list[float] = []
        if not self.kinds:
            return
        best = [max(k.log_likelihood(x) for k in self.kinds) for x in unlabelled]
        ordinary = unlabelled
        for _ in range(ROUNDS):
            self.ordinary = _learned(ordinary)
            # What is not clearly likelier as an ordinary token may be a credential.
            rest = [
                x for x, likely in zip(unlabelled, best, strict=True)
                if likely < self.ordinary.log_likelihood(x) - LEAST_GAIN
            ]
            if rest == ordinary:
                break
            ordinary = rest
        for strings in labelled:
            half = _learned(strings[::2])
            gains = sorted(
                half.log_likelihood(x) - self.ordinary.log_likelihood(x) for x in strings[1::2]
            )
            self.cuts.append(max(LEAST_GAIN, PART * gains[int(QUANTILE * len(gains))]))

    def is_secret(self, token: str) -> bool:
        if not self.kinds:
            return False
        ordinary = self.ordinary.log_likelihood(token)
        return any(
            kind.log_likelihood(token) - ordinary > cut
            for kind, cut in zip(self.kinds, self.cuts, strict=True)
        )


def _learned(strings: list[str]) -> Automaton:
    return Automaton(x[:LONGEST_EXAMPLE] for x in strings).merge_states(ALPHA)


def fit(scanned: DataFrame) -> Scorer:
    """Learned from at most SAMPLE strings of each kind and SAMPLE ordinary ones, which is what
    comes to the driver."""
    examples = scanned.select(F.explode("examples").alias("x")).select("x.*")
    ordinary = scanned.select(F.explode("candidates").alias("x")).select(
        F.lit(-1).alias("kind"), "x.token"
    )
    short = F.substring("token", 1, LONGEST_EXAMPLE).alias("token")
    tokens = examples.unionByName(ordinary).select("kind", short).distinct()
    chosen: dict[int, list[str]] = {}
    for kind in (-1, *range(len(KINDS))):
        rows = (
            tokens.where(F.col("kind") == kind)
            .orderBy(F.md5("token"), "token")
            .limit(SAMPLE)
            .collect()
        )
        chosen[kind] = [r.token for r in rows]
    ordinary_tokens = chosen.pop(-1)
    return Scorer(chosen, ordinary_tokens)


def report(scanned: DataFrame, scorer: Scorer) -> DataFrame:
    """Per document the base spans and those that the automata add."""

    def work(batch: pa.RecordBatch):
        base = batch.column("base").to_pylist()
        more = [
            [
                (c["start"], len(KINDS), c["start"] + len(c["token"]))
                for c in found
                if scorer.is_secret(c["token"])
            ]
            for found in batch.column("candidates").to_pylist()
        ]
        listed = [[(x["start"], x["kind"], x["end"]) for x in b] for b in base]
        names = (*KINDS, FOUND)
        joined = [
            [",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in both]
            for both in (listed, [a + b for a, b in zip(listed, more, strict=True)])
        ]
        counts = [[sum(k == i for _, k, _ in b) for b in listed] for i in range(len(KINDS))]
        yield {
            "doc_id": batch.column("doc_id"),
            "n_assign": counts[0],
            "n_access": counts[1],
            "n_hex": counts[2],
            "base_spans": joined[0],
            "spans": joined[1],
        }

    return map_batches(
        scanned.select("doc_id", "base", "candidates"),
        work,
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string",
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    scanned = written(scan(docs), "secrets")
    return report(scanned, fit(scanned))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with ``mark`` in place of every secret, and n_chars of the new text."""
    scorer = fit(written(scan(docs).select("examples", "candidates"), "secrets"))

    @F.pandas_udf("string")
    def redacted(texts):
        return texts.map(lambda t: _without(t, scorer, mark), na_action="ignore")

    out = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), length))
    return out


def _without(text: str, scorer: Scorer, mark: str) -> str:
    base = base_spans(text)
    spans = [(s, e) for s, _, e in base] + [
        (s, s + len(c)) for s, c in candidates(text, base) if scorer.is_secret(c)
    ]
    out, done = [], 0
    for start, end in sorted(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]
