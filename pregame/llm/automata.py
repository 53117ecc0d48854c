"""Weighted acyclic automata over words: minimal, built from sorted phrases, with union and composition.

An automaton maps phrases (tuples of words as bytes) to positive whole numbers. States are numbered with all
targets before their sources, the last one is the start; a state has the weight of the phrase that ends in
it (0: none ends) and its arcs in the order of their words.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]


class Automaton:
    def __init__(self, weights: list[int], arcs: list[tuple[tuple[bytes, int], ...]]):
        self.weights, self.arcs = weights, arcs

    @classmethod
    def build(cls, phrases: Iterable[tuple[Phrase, int]]) -> Automaton:
        """From different phrases in ascending order: once a phrase leaves a path, the path's end can only be one
        of the known states or a new one, so at most one path is open at any time."""
        weights: list[int] = []
        arcs: list[tuple[tuple[bytes, int], ...]] = []
        known: dict[tuple, int] = {}
        last: Phrase = ()
        open_weights, open_arcs = [0], [[]]

        def close(depth: int) -> None:
            while len(open_weights) > depth:
                state = (open_weights.pop(), tuple(open_arcs.pop()))
                number = known.get(state)
                if number is None:
                    number = known[state] = len(weights)
                    weights.append(state[0])
                    arcs.append(state[1])
                if open_arcs:
                    open_arcs[-1].append((last[len(open_arcs) - 1], number))

        for phrase, weight in phrases:
            same, most = 0, min(len(phrase), len(last))
            while same < most and phrase[same] == last[same]:
                same += 1
            close(same + 1)
            for _ in range(same, len(phrase)):
                open_weights.append(0)
                open_arcs.append([])
            open_weights[-1] = weight
            last = phrase
        close(1)
        # The start is always a state of its own, and the last one.
        weights.append(open_weights[0])
        arcs.append(tuple(open_arcs[0]))
        return cls(weights, arcs)

    def items(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases in ascending order."""
        stack: list[tuple[Phrase, int]] = [((), len(self.weights) - 1)]
        while stack:
            phrase, state = stack.pop()
            if self.weights[state]:
                yield phrase, self.weights[state]
            for word, target in reversed(self.arcs[state]):
                stack.append(((*phrase, word), target))

    def compose(self, other: Automaton) -> Iterator[tuple[Phrase, int]]:
        """The phrases of `other` that have a weight here, with the weight that they have here."""
        indexes: dict[int, dict[bytes, int]] = {}
        stack = [((), len(self.weights) - 1, len(other.weights) - 1)]
        while stack:
            phrase, mine, its = stack.pop()
            if self.weights[mine] and other.weights[its]:
                yield phrase, self.weights[mine]
            if mine not in indexes:
                indexes[mine] = dict(self.arcs[mine])
            mine_by_word = indexes[mine]
            for word, target in reversed(other.arcs[its]):
                if (to := mine_by_word.get(word)) is not None:
                    stack.append(((*phrase, word), to, target))

    def to_bytes(self) -> bytes:
        """Words must not hold a newline."""
        words = sorted({w for arcs in self.arcs for w, _ in arcs})
        number = {w: i for i, w in enumerate(words)}
        parts = [
            np.array([len(self.weights), sum(map(len, self.arcs))], np.int64),
            np.array(self.weights, np.int64), np.array([len(a) for a in self.arcs], np.int64),
            np.array([(number[w] << 32) | t for arcs in self.arcs for w, t in arcs], np.int64),
        ]
        return zlib.compress(b"".join(p.tobytes() for p in parts) + b"\n".join(words), 1)

    @classmethod
    def from_bytes(cls, stored: bytes) -> Automaton:
        raw = zlib.decompress(stored)
        states, n_arcs = np.frombuffer(raw, np.int64, 2).tolist()
        weights = np.frombuffer(raw, np.int64, states, 16).tolist()
        sizes = np.frombuffer(raw, np.int64, states, 16 + 8 * states)
        packed = np.frombuffer(raw, np.int64, n_arcs, 16 + 16 * states)
        words = raw[16 + 16 * states + 8 * n_arcs:].split(b"\n")
        flat = [(words[a >> 32], a & 0xFFFFFFFF) for a in packed.tolist()]
        ends = np.cumsum(sizes).tolist()
        return cls(weights, [tuple(flat[e - s:e]) for s, e in zip(sizes.tolist(), ends)])


def summed(sources: Iterable[Iterable[tuple[Phrase, int]]]) -> Iterator[tuple[Phrase, int]]:
    """Ascending phrases of all sources, each once, with the sum of its weights."""
    last, total = None, 0
    for phrase, weight in heapq.merge(*sources):
        if phrase != last:
            if last is not None:
                yield last, total
            last, total = phrase, 0
        total += weight
    if last is not None:
        yield last, total


class Union:
    """The running union of many automata: `FANIN` of a level are merged into one of the next, so few are held at a time."""

    FANIN = 32

    def __init__(self) -> None:
        self.levels: list[list[Automaton]] = []

    def add(self, automaton: Automaton, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(automaton)
        if len(self.levels[level]) == self.FANIN:
            full, self.levels[level] = self.levels[level], []
            self.add(Automaton.build(summed(a.items() for a in full)), level + 1)

    def items(self) -> Iterator[tuple[Phrase, int]]:
        return summed(a.items() for level in self.levels for a in level)
