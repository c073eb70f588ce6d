"""Words of many texts at once, as 64-bit hashes made with array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look random (splitmix64's finisher)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed numbers that look random."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(1 << 32)) * GOLDEN)


BYTE_CODES = stream(256, 1)
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number, as many as any word so far needed."""
    global _powers
    if len(_powers) < n:
        base = np.full(2 * n, GOLDEN)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a column without nulls: number of the first text, their bytes, and where each
    text starts in them (and the last ends). A part has CHUNK_BYTES, or one longer text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, whole[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """The words' hashes in order, how many each text has, and where each starts and ends."""
    n_texts = len(at) - 1
    if lower:
        data = LOWER[data]
    inside = ~IS_WHITE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at)) if n_texts else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts, starts, starts
    number = np.cumsum(begins, dtype=np.int64) - 1
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    place[~inside] = 0
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    with np.errstate(over="ignore"):
        codes = BYTE_CODES[data] * powers(int(lengths.max()) + 1)[np.maximum(place, 0)]
        codes[~inside] = 0
        sums = np.add.reduceat(codes, starts)
        hashes = mix(sums + lengths.astype(np.uint64) * GOLDEN)
    return hashes, counts, starts, starts + lengths


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Hashes of all runs of ``width`` words of each text, and how many each text has. A text of
    fewer words, but some, is one run."""
    keys = stream(width, 2) | U64(1)
    ends = np.cumsum(counts)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    with np.errstate(over="ignore"):
        total = len(hashes)
        text = np.repeat(np.arange(len(counts)), counts)
        left = ends[text] - np.arange(total) if total else np.zeros(0, dtype=np.int64)
        sums = np.zeros(total, dtype=np.uint64)
        for i in range(width):
            part = hashes[i:] * keys[i]
            sums[: total - i] += np.where(left[: total - i] > i, part, U64(0))
        begin = ends - counts
        is_start = left >= width
        short = begin[(counts > 0) & (counts < width)]
        is_start[short] = True
        return mix(sums[is_start] + U64(width)), n
