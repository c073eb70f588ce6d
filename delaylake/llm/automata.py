"""Probabilistic automata learned from example strings by merging prefix-tree states."""

from __future__ import annotations

import math
from collections.abc import Iterable

#: Characters a candidate can hold, and the end: the outcomes over which counts are smoothed.
OUTCOMES = 26 + 26 + 10 + 7 + 1


class Automaton:
    """States with counts. State 0 is the start; ``edges[s][c]`` is [target, count]."""

    def __init__(self, strings: Iterable[str] = ()):
        self.edges: list[dict[str, list[int]]] = [{}]
        self.total = [0]
        self.ends = [0]
        for text in strings:
            self._add(text)

    def _add(self, text: str) -> None:
        state = 0
        self.total[0] += 1
        for c in text:
            edge = self.edges[state].get(c)
            if edge is None:
                self.edges.append({})
                self.total.append(0)
                self.ends.append(0)
                edge = self.edges[state][c] = [len(self.edges) - 1, 0]
            edge[1] += 1
            state = edge[0]
            self.total[state] += 1
        self.ends[state] += 1

    def merge_states(self, alpha: float) -> Automaton:
        """Merge every state that is statistically compatible with one that is settled.

        Settled states grow from the start; the states right after them are taken by falling
        count. Two states are compatible if their shares of ends and of each character differ
        by less than Hoeffding's bound, and so do the states that the characters lead to."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        while True:
            known = set(settled)
            fringe = {
                edge[0]: (state, c)
                for state in settled
                for c, edge in self.edges[state].items()
                if edge[0] not in known
            }
            if not fringe:
                return self._compact(settled)
            new = max(fringe, key=lambda s: (self.total[s], -s))
            for old in settled:
                if self._compatible(old, new, width):
                    parent, c = fringe[new]
                    self.edges[parent][c][0] = old
                    self._fold(old, new)
                    break
            else:
                settled.append(new)

    def _compatible(self, old: int, new: int, width: float) -> bool:
        pairs = [(old, new)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # shares cannot differ by more; below b the counts are smaller still
            if abs(self.ends[a] / n - self.ends[b] / m) >= bound:
                return False
            for c in self.edges[a].keys() | self.edges[b].keys():
                to_a, to_b = self.edges[a].get(c), self.edges[b].get(c)
                if abs((to_a[1] if to_a else 0) / n - (to_b[1] if to_b else 0) / m) >= bound:
                    return False
                if to_a and to_b:
                    pairs.append((to_a[0], to_b[0]))
        return True

    def _fold(self, old: int, new: int) -> None:
        pairs = [(old, new)]
        while pairs:
            a, b = pairs.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for c, (target, count) in self.edges[b].items():
                edge = self.edges[a].get(c)
                if edge is None:
                    self.edges[a][c] = [target, count]
                else:
                    edge[1] += count
                    pairs.append((edge[0], target))

    def _compact(self, settled: list[int]) -> Automaton:
        number = {s: i for i, s in enumerate(settled)}
        out = Automaton()
        out.edges = [
            {c: [number[t], n] for c, (t, n) in self.edges[s].items()} for s in settled
        ]
        out.total = [self.total[s] for s in settled]
        out.ends = [self.ends[s] for s in settled]
        return out

    def log_likelihood(self, text: str) -> float:
        """Natural logarithm of the string's probability. Outcomes count one more than seen; a
        character never seen in a state stays in it."""
        state, sum_ = 0, 0.0
        for c in text:
            whole = self.total[state] + OUTCOMES
            edge = self.edges[state].get(c)
            if edge is None:
                sum_ -= math.log(whole)
            else:
                sum_ += math.log((edge[1] + 1) / whole)
                state = edge[0]
        return sum_ + math.log((self.ends[state] + 1) / (self.total[state] + OUTCOMES))
