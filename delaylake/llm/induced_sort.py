"""Sorting the suffixes of a text by induction, with queues that go to disk.

The suffixes that start a rising stretch right after a falling one (LMS) are put in order first,
by the same two passes over their unsorted list and, where that leaves some alike, by the order
of the shorter text of their names. Two passes then induce all others: upwards, each sorted
suffix passes on the one before it if that starts with a larger character, and downwards if it
starts with a smaller one. What is passed on waits in a queue for its first character. The queue
is a priority queue of suffixes whose order within a character is that of arrival; it takes and
gives whole runs of positions. Beyond ``memory`` positions the fullest characters' runs go to an
unnamed temporary file of the task, as a sort's spills do.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 32_000_000


class DiskQueue:
    """Positions waiting by character, in the order in which they came."""

    def __init__(self, characters: int, memory: int):
        self.waiting: list[list] = [[] for _ in range(characters)]
        self.loads = np.zeros(characters, dtype=np.int64)
        self.memory, self.held, self.file = memory, 0, None

    def put(self, characters: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(characters, kind="stable")
        characters, positions = characters[order], positions[order]
        cuts = np.flatnonzero(np.diff(characters)) + 1
        for c, part in zip(
            characters[np.append(0, cuts)], np.split(positions, cuts), strict=True
        ):
            self.waiting[c].append(part)
            self.loads[c] += len(part)
        self.held += len(positions)
        while self.held > self.memory:
            self._spill(int(self.loads.argmax()))

    def _spill(self, c: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        parts = self.waiting[c]
        whole = np.concatenate([p for p in parts if isinstance(p, np.ndarray)])
        self.file.write(whole.tobytes())
        self.waiting[c] = [p for p in parts if not isinstance(p, np.ndarray)]
        self.waiting[c].append((at, len(whole)))
        self.held -= len(whole)
        self.loads[c] = 0

    def take(self, c: int) -> np.ndarray:
        """All positions of a character; they leave the queue."""
        parts, self.waiting[c] = self.waiting[c], []
        self.held -= int(self.loads[c])
        self.loads[c] = 0
        out = [np.zeros(0, dtype=np.int64)]
        for part in parts:
            if not isinstance(part, np.ndarray):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), dtype=np.int64)
            out.append(part)
        return np.concatenate(out)


def rising(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one (S); the last one is."""
    step = np.sign(np.diff(text.astype(np.int64)))
    place = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(len(text), dtype=bool)
    out[:-1] = np.append(step, 1)[following] > 0
    return out


def induce(
    text: np.ndarray, is_rising: np.ndarray, lms: np.ndarray, characters: int, memory: int
) -> Iterator[np.ndarray]:
    """All suffixes from the largest to the smallest, in runs, given the LMS ones in order."""
    first_of = np.searchsorted(text[lms], np.arange(characters + 1))
    queue, falling = DiskQueue(characters, memory), DiskQueue(characters, memory)

    def pass_on(places: np.ndarray, want: bool, c: int) -> np.ndarray:
        """Queue the suffixes before ``places`` of the wanted kind; returns those that start
        with c too, which are next in line."""
        before = places[places > 0] - 1
        before = before[is_rising[before] == want]
        first = text[before]
        same = first == c
        if not same.all():
            queue.put(first[~same].astype(np.int64), before[~same])
        return before[same]

    for c in range(characters):
        wave = queue.take(c)
        while len(wave):
            falling.put(np.full(len(wave), c), wave)
            wave = pass_on(wave, False, c)
        pass_on(lms[first_of[c] : first_of[c + 1]], False, c)
    for c in reversed(range(characters)):
        wave = queue.take(c)
        if c == 0:
            wave = np.array([len(text) - 1])
        while len(wave):
            yield wave
            wave = pass_on(wave, True, c)
        down = falling.take(c)[::-1]
        if len(down):
            yield down
            wave = pass_on(down, True, c)
            assert not len(wave)


def by_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of numbers: ranks of runs of 1, 2, 4, ... of them."""
    rank, run, size = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(size, dtype=np.int64)
        second[:-run] = rank[run:] + 1 if run < size else 0
        order = np.lexsort((second, rank))
        new = np.ones(size, dtype=np.int64)
        new[1:] = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        new = np.cumsum(new) - 1
        rank = np.empty(size, dtype=np.int64)
        rank[order] = new
        if new[-1] == size - 1:
            return order
        run *= 2


def sort_suffixes(text: np.ndarray, characters: int, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """The suffixes of ``text`` from the largest to the smallest, in runs. Its last character
    is 0, and no other is."""
    is_rising = rising(text)
    starts = is_rising.copy()
    starts[0] = False
    starts[1:] &= ~is_rising[:-1]
    lms = np.flatnonzero(starts)
    if len(lms) > 1:
        # Any order within a character sorts the LMS stretches.
        rough = lms[np.argsort(text[lms], kind="stable")]
        runs = [r[starts[r]] for r in induce(text, is_rising, rough, characters, memory)]
        stretch = np.concatenate(runs)[::-1]
        names = _names(text, lms, stretch)
        in_order = by_names(names)
        lms = lms[in_order]
    yield from induce(text, is_rising, lms, characters, memory)


def _names(text: np.ndarray, lms: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Numbers of the LMS stretches in their order, equal ones alike, by place in the text."""
    ends = np.append(lms[1:] + 1, len(text))
    number = np.empty(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    own = number[stretch]
    lengths = ends[own] - lms[own]
    differs = np.ones(len(own), dtype=bool)
    differs[1:] = lengths[1:] != lengths[:-1]
    same = np.flatnonzero(~differs)
    at = 0
    while len(same):
        left, right = stretch[same - 1] + at, stretch[same] + at
        unequal = text[left] != text[right]
        differs[same[unequal]] = True
        at += 1
        same = same[~unequal]
        same = same[lengths[same] > at]
    names = np.empty(len(lms), dtype=np.int64)
    names[own] = np.cumsum(differs) - 1
    return names


def common_prefix_at_least(
    text: np.ndarray, places: np.ndarray, length: int, chunk: int = 1 << 16
) -> np.ndarray:
    """Whether each place's suffix shares ``length`` characters with that of the place before."""
    out = np.zeros(len(places), dtype=bool)
    columns = np.arange(length)
    for first in range(1, len(places), chunk):
        now = places[first : first + chunk]
        before = places[first - 1 : first - 1 + len(now)]
        equal = text[now[:, None] + columns] == text[before[:, None] + columns]
        out[first : first + chunk] = equal.all(axis=1)
    return out
