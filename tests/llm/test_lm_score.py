import math
import re
import zlib
from collections import Counter

import numpy as np
from cases import AWKWARD_TEXTS, documents, with_clashes

from delaylake.llm import lm_score
from delaylake.llm import recurrent as rnn
from delaylake.llm.common import read
from delaylake.llm.lm_score import lm_scores

UPPER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER)), None]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(rows, docs):
    counts = Counter(t for i, text in docs if not is_held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    expected = []
    for i, text in docs:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        expected.append((i, is_held(i), len(own), sum(counts[t] > 0 for t in own), total, base))
    key = lambda x: (str(x[0]), x[2], x[5])
    found = sorted(
        [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows],
        key=key,
    )
    for a, b in zip(found, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def test_given_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = lm_scores(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_blocks_make_no_difference_to_counts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50)
    texts = [f"Word{i % 7} word{i % 3} the THE rare{i}" for i in range(120)]
    rows = lm_scores(documents(spark, texts).repartition(3)).collect()
    check_base(rows, list(enumerate(texts)))


def test_awkward_texts(spark):
    docs = with_clashes(documents(spark, AWKWARD_TEXTS).repartition(2), "block", "ids", "word")
    check_base(lm_scores(docs).collect(), list(enumerate(AWKWARD_TEXTS)))


def test_null_and_repeated_ids(spark):
    docs = [(None, "a b"), (3, "a c"), (3, "a c"), (None, None)]
    rows = lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_base(rows, docs)


def test_only_held_out_documents(spark):
    held = [i for i in range(100) if is_held(i)]
    docs = [(i, "some words") for i in held]
    rows = lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_base(rows, docs)
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def test_empty_table(spark):
    assert lm_scores(documents(spark, ["x"]).where("false")).collect() == []


def small_model():
    rng = np.random.default_rng(1)
    return rnn.initial(rng.integers(0, 30, rnn.TOKENS)), rng


def test_probabilities_sum_to_one():
    p, rng = small_model()
    h = rng.standard_normal((1, rnn.HIDDEN)).astype(np.float32)
    all_tokens = np.arange(rnn.TOKENS)
    logs = rnn.log_probabilities(p, np.repeat(h, rnn.TOKENS, axis=0), all_tokens)
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)


def test_gradients():
    p, rng = small_model()
    inputs, targets = (rng.integers(0, rnn.TOKENS, (6, 4)) for _ in range(2))
    inputs[3, 1] = 0
    h = (0.1 * rng.standard_normal((4, rnn.HIDDEN))).astype(np.float32)

    def loss(q):
        states, _ = rnn.run_states(q, inputs, h)
        logs = rnn.log_probabilities(q, states.reshape(-1, rnn.HIDDEN), targets.ravel())
        return -logs.mean()

    grads, _, value = rnn.gradients(p, inputs, targets, h)
    assert math.isclose(value, loss(p), rel_tol=1e-5)
    for k, g in grads.items():
        # Along the gradient itself, the slope is its length.
        length = float(np.sqrt((g.astype(np.float64) ** 2).sum()))
        step = 0.02 / length
        up, down = ({**p, k: p[k] + s * step * g} for s in (1, -1))
        assert math.isclose((loss(up) - loss(down)) / (2 * step), length**2, rel_tol=0.03), k


def test_score_does_not_depend_on_the_other_texts():
    p, rng = small_model()
    texts = [np.append(rng.integers(1, rnn.TOKENS, n), 0) for n in (0, 1, 5, 31, 32, 33, 200, 7)]
    together = rnn.score(p, texts)
    assert np.allclose(together, [rnn.score(p, [t])[0] for t in texts], rtol=1e-4)
    one = texts[6]
    states, _ = rnn.run_states(
        p, np.append(0, one[:-1])[:, None], np.zeros((1, rnn.HIDDEN), dtype=np.float32)
    )
    whole = rnn.log_probabilities(p, states[:, 0], one).sum()
    assert math.isclose(whole, together[6], rel_tol=1e-4)


def test_training_learns_what_comes_next():
    stream = np.tile(np.array([5, 9, 40, 7, 0]), 400)
    p = rnn.initial(np.bincount(stream, minlength=rnn.TOKENS))
    before = rnn.score(p, [stream[:5]])[0]
    assert rnn.score(rnn.train(p, stream, 8, 150, 0.02), [stream[:5]])[0] > before / 4


def test_weights_pack():
    p, _ = small_model()
    back = rnn.unpack(rnn.pack(p))
    assert all(np.array_equal(p[k], back[k]) for k in p)


def test_weights_are_averaged_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MEAN_OF", 2)
    texts = [f"a b c d e f g {i % 5} " * 20 for i in range(300)]
    rows = lm_scores(documents(spark, texts).repartition(7)).collect()
    check_base(rows, list(enumerate(texts)))
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_token_is_learned_from_once(monkeypatch):
    rng = np.random.default_rng(2)
    seen = np.zeros(rnn.TOKENS, dtype=np.int64)
    gradients = rnn.gradients

    def counting(p, inputs, targets, h):
        np.add.at(seen, targets, 1)
        return gradients(p, inputs, targets, h)

    monkeypatch.setattr(rnn, "gradients", counting)
    p, _ = small_model()
    # More than the 40 windows of 64 lanes that a task once ended after, and a few odd sizes.
    for sizes, block in (([60_000, 70_001], 3_000_000), ([5, 700, 33, 0, 4099], 1000), ([1], 50)):
        monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
        texts = [rng.integers(0, rnn.TOKENS, n).astype("<u2") for n in sizes]
        seen[:] = 0
        _, n = lm_score.learn_all(p, iter(texts))
        expected = np.bincount(np.concatenate(texts), minlength=rnn.TOKENS)
        assert n == sum(sizes) and np.array_equal(seen, expected)


def test_all_training_documents_are_learned_from(spark, monkeypatch):
    learned = []

    def noting(table, name):
        out = kept(table, name)
        if name == "models":
            learned.append(sum(r.n for r in out.select("n").collect()))
        return out

    kept = lm_score.written
    monkeypatch.setattr(lm_score, "written", noting)
    docs = [(None, "a b")] * 5 + [(i, "some words here") for i in range(100)]
    rows = lm_scores(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ).collect()
    trained = sum(len(tokens(text)) for i, text in docs if not is_held(i))
    assert learned[0] == trained == rows[0].train_tokens
