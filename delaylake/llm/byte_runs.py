"""Windows of the bytes of many texts, gathered in runs that share an anchor.

The anchor of a window is its gram with the smallest hash, the first of such; it depends on the
window's bytes only, so equal windows have equal anchors wherever they are. Consecutive windows
with the same anchor are a run.
"""

from __future__ import annotations

import numpy as np

from delaylake.llm.word_hashes import GOLDEN, U64, mix, stream

WINDOW = 50
GRAM = 24
GRAMS = WINDOW - GRAM + 1
CHUNK = 1 << 20

CODES = stream(256, 11)
#: Bits of a place in a chunk, below those of a gram's hash.
PLACE = U64(24)
STEP = GOLDEN
#: The inverse of STEP in 64 bits.
BACK = U64(pow(int(GOLDEN), -1, 1 << 64))


def _power(n: int) -> np.uint64:
    return U64(pow(int(STEP), n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place; the last places run over the end."""
    # By runs of 1, 2, 4, ... bytes, and those put together.
    by_size = {1: CODES[data]}
    size = 1
    while 2 * size <= GRAM:
        part, out = by_size[size], by_size[size].copy()
        out[:-size] += part[size:] * _power(size)
        by_size[2 * size] = out
        size *= 2
    total, at = np.zeros(len(data), dtype=np.uint64), 0
    for size in sorted(by_size, reverse=True):
        while at + size <= GRAM:
            total[: len(data) - at] += by_size[size][at:] * _power(at)
            at += size
    return mix(total)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive numbers; as many as there are whole such."""
    out, size = x, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all windows inside the texts: each run's first place, number of windows, hash of its
    anchor (40 bits) and the anchor's place. ``at`` has where the texts start, and the end."""
    total = len(data)
    inside = np.zeros(total + 1, dtype=np.int8)
    lengths = np.diff(at)
    long = lengths >= WINDOW
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - WINDOW + 1, -1)
    valid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    least = np.zeros(total, dtype=np.uint64)
    anchor = np.full(total, -1, dtype=np.int64)
    mask = (U64(1) << PLACE) - U64(1)
    with np.errstate(over="ignore"):
        for first in range(0, total - WINDOW + 1, CHUNK):
            part = data[first : first + CHUNK + WINDOW - 1]
            hashes = gram_hashes(part)[: len(part) - GRAM + 1]
            keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
            found = sliding_least(keys, GRAMS)
            least[first : first + len(found)] = found >> PLACE
            anchor[first : first + len(found)] = (found & mask).astype(np.int64) + first
    places = np.flatnonzero(valid)
    if not len(places):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    own = anchor[places]
    begins = np.ones(len(places), dtype=bool)
    begins[1:] = (np.diff(own) != 0) | (np.diff(places) != 1)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(places)))
    return places[starts], sizes, least[places[starts]], own[starts]


def content_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits for each of the stretches, in order of start."""
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    widest = int(lengths.max())
    n = min(CHUNK, len(data)) + widest + 1
    up, down = (np.full(n, x) for x in (STEP, BACK))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        for first in range(0, len(data), CHUNK):
            i, j = np.searchsorted(starts, [first, first + CHUNK])
            if i == j:
                continue
            part = CODES[data[first : first + CHUNK + widest]]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:], dtype=np.uint64)
            own = starts[i:j] - first
            sums = (sums[own + lengths[i:j]] - sums[own]) * down[own]
            out[i:j] = mix(sums + lengths[i:j].astype(np.uint64) * GOLDEN)
    return out
