"""A small gated recurrent language model in numpy.

Tokens are numbers: 0 ends a text, 1 to HEAD are frequent words, the rest are bins of rare
words. The output is factored: a softmax over classes, and for frequent words a softmax over the
words of their class. Training is by truncated backpropagation through windows; the state runs
on from window to window and starts anew with each text.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASS_WORDS = 32
HEAD_CLASSES = 32
HEAD = CLASS_WORDS * HEAD_CLASSES
BINS = 31
TOKENS = 1 + HEAD + BINS
CLASSES = 1 + HEAD_CLASSES + BINS
HIDDEN = 24
WINDOW = 32
LANES = 512

#: Class of each token.
CLASS_OF = np.concatenate(
    [[0], 1 + np.arange(HEAD) // CLASS_WORDS, 1 + HEAD_CLASSES + np.arange(BINS)]
).astype(np.uint8)

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray) -> Params:
    """Weights that give each token its share of ``counts``, whatever came before."""
    rng = np.random.default_rng(7)
    counts = counts.astype(np.float64) + 1e-3
    per_class = np.bincount(CLASS_OF, counts, CLASSES)
    words = counts[1 : HEAD + 1].reshape(HEAD_CLASSES, CLASS_WORDS)

    def small(*shape: int) -> np.ndarray:
        return (0.1 * rng.standard_normal(shape)).astype(np.float32)

    return {
        "input": small(TOKENS, 3 * HIDDEN),
        "state": small(HIDDEN, 3 * HIDDEN) * 3,
        "classes": small(HIDDEN, CLASSES) * 0.1,
        "class_bias": np.log(per_class / per_class.sum()).astype(np.float32),
        "words": small(HEAD_CLASSES, HIDDEN, CLASS_WORDS) * 0.1,
        "word_bias": np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def run_states(p: Params, inputs: np.ndarray, h: np.ndarray, keep: dict | None = None):
    """States after each step of a window (steps, lanes); an input of 0 starts a new text.
    ``keep`` gets what the backward pass needs, for all steps at once. Inside, lanes are the last
    axis, so that gates are whole blocks."""
    steps, lanes = inputs.shape
    out = np.empty((steps, HIDDEN, lanes), dtype=np.float32)
    # A gate is (tanh(x / 2) + 1) / 2.
    half = np.ones(3 * HIDDEN, dtype=np.float32)
    half[: 2 * HIDDEN] = 0.5
    state = np.ascontiguousarray((p["state"] * half).T)
    read = np.ascontiguousarray((p["input"] * half)[inputs].transpose(0, 2, 1))
    starts = inputs == 0
    h = np.ascontiguousarray(h.T)
    if keep is not None:
        keep["gates"] = np.empty((steps, 2 * HIDDEN, lanes), dtype=np.float32)
        keep |= {k: np.empty_like(out) for k in ("before", "part", "new")}
    for t in range(steps):
        if starts[t].any():
            h = np.where(starts[t], np.float32(0), h)
        both = state @ h
        gates, part, new = both[: 2 * HIDDEN], both[2 * HIDDEN :], None
        if keep is not None:
            keep["before"][t], keep["part"][t] = h, part
            new = keep["new"][t]
        gates += read[t, : 2 * HIDDEN]
        gates = np.tanh(gates, out=gates if keep is None else keep["gates"][t])
        gates *= 0.5
        gates += 0.5
        new = np.multiply(gates[HIDDEN:], part, out=new)
        new += read[t, 2 * HIDDEN :]
        np.tanh(new, out=new)
        step = np.subtract(h, new, out=out[t])
        step *= gates[:HIDDEN]
        step += new
        h = step
    return out.transpose(0, 2, 1), h.T


def softmax(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithm of the probability of each column's chosen row; all rows' probabilities
    before and the sum that they are divided by. ``x`` is overwritten."""
    x -= x.max(axis=0)
    picked = x[chosen, np.arange(x.shape[1])]
    np.exp(x, out=x)
    whole = np.ones(len(x), dtype=x.dtype) @ x
    return picked - np.log(whole), x, whole


def log_probabilities(p: Params, h: np.ndarray, targets: np.ndarray, grads=None) -> np.ndarray:
    """Natural logarithm of each target's probability given its state. ``grads`` gets the
    gradients of their negative sum, also that of the states under "h"."""
    # By class, so that the states of a class lie together.
    order = np.argsort(CLASS_OF[targets], kind="stable")
    targets, h = targets[order], h[order]
    classes = CLASS_OF[targets]
    logs, d, whole = softmax(p["classes"].T @ h.T + p["class_bias"][:, None], classes)
    found = logs.astype(np.float64)
    if grads is not None:
        d /= whole
        d[classes, np.arange(len(targets))] -= 1
        grads["classes"], grads["class_bias"] = h.T @ d.T, d.sum(axis=1)
        d_h = d.T @ p["classes"].T
        grads["words"] = np.zeros_like(p["words"])
        grads["word_bias"] = np.zeros_like(p["word_bias"])
    cuts = np.searchsorted(classes, np.arange(1, HEAD_CLASSES + 2))
    for k in range(HEAD_CLASSES):
        at = slice(cuts[k], cuts[k + 1])
        if at.start == at.stop:
            continue
        word = targets[at].astype(np.int64) - (1 + k * CLASS_WORDS)
        own = h[at]
        logs, d, whole = softmax(p["words"][k].T @ own.T + p["word_bias"][k][:, None], word)
        found[at] += logs
        if grads is not None:
            d /= whole
            d[word, np.arange(len(word))] -= 1
            grads["words"][k], grads["word_bias"][k] = own.T @ d.T, d.sum(axis=1)
            d_h[at] += d.T @ p["words"][k].T
    out = np.empty_like(found)
    out[order] = found
    if grads is not None:
        grads["h"] = np.empty_like(d_h)
        grads["h"][order] = d_h
    return out


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray):
    """Gradients of a window's mean loss, the state after it, and the loss."""
    kept: dict = {}
    states, last = run_states(p, inputs, h, kept)
    grads: Params = {}
    logs = log_probabilities(p, states.reshape(-1, HIDDEN), targets.ravel(), grads)
    d_states = np.ascontiguousarray(grads.pop("h").reshape(states.shape).transpose(0, 2, 1))
    before, part, new = kept["before"], kept["part"], kept["new"]
    z, r = kept["gates"][:, :HIDDEN], kept["gates"][:, HIDDEN:]
    # What a step's gradient is multiplied with, for all steps at once.
    to_new, to_z = (1 - z) * (1 - new * new), (before - new) * z * (1 - z)
    to_r, starts = part * r * (1 - r), inputs == 0
    steps, lanes = inputs.shape
    d_new = np.empty_like(d_states)
    d_state = np.empty((steps, 3 * HIDDEN, lanes), dtype=np.float32)
    d_next = np.zeros((HIDDEN, lanes), dtype=np.float32)
    for t in reversed(range(steps)):
        dh = d_states[t]
        dh += d_next
        own = np.multiply(dh, to_new[t], out=d_new[t])
        np.multiply(dh, to_z[t], out=d_state[t, :HIDDEN])
        np.multiply(own, to_r[t], out=d_state[t, HIDDEN : 2 * HIDDEN])
        np.multiply(own, r[t], out=d_state[t, 2 * HIDDEN :])
        d_next = p["state"] @ d_state[t]
        dh *= z[t]
        d_next += dh
        if starts[t].any():
            d_next[:, starts[t]] = 0
    grads["state"] = np.matmul(before, d_state.transpose(0, 2, 1)).sum(axis=0)
    d_state[:, 2 * HIDDEN :] = d_new
    order = np.argsort(inputs, axis=None, kind="stable")
    read = inputs.ravel()[order]
    first = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
    grads["input"] = np.zeros_like(p["input"])
    grads["input"][read[first]] = np.add.reduceat(
        d_state.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first
    )
    n = targets.size
    return {k: g / n for k, g in grads.items()}, last, -logs.sum() / n


class Adam:
    def __init__(self, p: Params, rate: float):
        self.rate, self.step = rate, 0
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: Params, grads: Params) -> None:
        self.step += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            mean = self.first[k] / (1 - 0.9**self.step)
            square = self.second[k] / (1 - 0.99**self.step)
            p[k] = (p[k] - self.rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)


def windows(sizes: list[int]) -> list[tuple[slice, int]]:
    """Steps and lanes of each window over lanes of ``sizes`` tokens, which differ by one at
    most, the longer ones first. Every token is in one window."""
    longest, least = sizes[0], sizes[-1]
    out = [(slice(at, min(at + WINDOW, least)), len(sizes)) for at in range(0, least, WINDOW)]
    if longest > least:
        out.append((slice(least, longest), sizes.index(least)))
    return out


def train(
    p: Params, stream: np.ndarray, lanes: int, steps: int | None, rate: float
) -> Params:
    """``steps`` windows over texts laid end to end; they are read again when they end. Without
    a number of steps, every token is read once."""
    p = {k: v.copy() for k, v in p.items()}
    if not len(stream):
        return p
    laid = np.array_split(stream, min(lanes, max(1, len(stream) // WINDOW)))
    targets = np.zeros((len(laid[0]), len(laid)), dtype=np.uint16)
    for lane, own in enumerate(laid):
        targets[: len(own), lane] = own
    inputs = np.vstack([np.zeros((1, len(laid)), dtype=np.uint16), targets[:-1]])
    all_windows = windows([len(own) for own in laid])
    steps = len(all_windows) if steps is None else steps
    adam, h = Adam(p, rate), np.zeros((len(laid), HIDDEN), dtype=np.float32)
    for step in range(steps):
        window, active = all_windows[step % len(all_windows)]
        if window.start == 0:
            h = np.zeros((len(laid), HIDDEN), dtype=np.float32)
        adam.rate = rate * (1 - step / steps) + 0.1 * rate
        grads, h, _ = gradients(
            p, inputs[window, :active], targets[window, :active], h[:active]
        )
        adam.update(p, grads)
    return p


def score(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole text (its numbers, the last of them 0)."""
    lanes = min(LANES, len(texts))
    if not lanes:
        return np.zeros(0)
    queue, of_lane = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        load, lane = heapq.heappop(queue)
        of_lane[lane].append(i)
        heapq.heappush(queue, (load + len(texts[i]), lane))
    of_lane.sort(key=lambda own: -sum(len(texts[i]) for i in own))
    loads = np.array([sum(len(texts[i]) for i in own) for own in of_lane])
    steps = int(loads[0])
    owners = [np.repeat(own, [len(texts[i]) for i in own]) for own in of_lane]
    streams = [np.concatenate([texts[i] for i in own]) for own in of_lane]
    out = np.zeros(len(texts))
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    last = np.zeros(lanes, dtype=np.int64)
    for at in range(0, steps, WINDOW):
        active = int(np.searchsorted(-loads, -at))
        size = min(WINDOW, steps - at)
        targets = np.zeros((size, active), dtype=np.int64)
        owner = np.full((size, active), -1)
        for lane in range(active):
            part = streams[lane][at : at + size]
            targets[: len(part), lane] = part
            owner[: len(part), lane] = owners[lane][at : at + size]
        inputs = np.vstack([last[None, :active], targets[:-1]])
        states, h = run_states(p, inputs, h[:active])
        last = targets[-1]
        real = owner.ravel() >= 0
        logs = log_probabilities(p, states.reshape(-1, HIDDEN)[real], targets.ravel()[real])
        out += np.bincount(owner.ravel()[real], logs, len(texts))
    return out


def pack(p: Params) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], dtype="<f4").tobytes() for k in sorted(p))


def unpack(data: bytes) -> Params:
    shapes = {k: v.shape for k, v in initial(np.ones(TOKENS)).items()}
    flat, out, at = np.frombuffer(data, dtype="<f4"), {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at : at + n].reshape(shapes[k]).astype(np.float32)
        at += n
    return out
