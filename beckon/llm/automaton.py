"""Generalised suffix automata over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """Recognises every substring of the sequences added so far.

    State 0 is the root.  ``length`` is a state's longest substring, ``link`` its suffix link and
    ``step`` its transitions.
    """

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def __len__(self) -> int:
        return len(self.step)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, state: int, symbol: int, child: int) -> int:
        """Give the part of ``child`` that continues ``state`` a state of its own."""
        twin = self._new(self.length[state] + 1, self.link[child], dict(self.step[child]))
        self.link[child] = twin
        while state >= 0 and self.step[state].get(symbol) == child:
            self.step[state][symbol] = twin
            state = self.link[state]
        return twin

    def add(self, sequence: Iterable[int]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for symbol in sequence:
            child = step[last].get(symbol)
            if child is not None:  # an earlier sequence has this prefix
                last = child if length[child] == length[last] + 1 else self._split(last, symbol, child)
                continue
            fresh = self._new(length[last] + 1, 0, {})
            state = last
            while state >= 0 and symbol not in step[state]:
                step[state][symbol] = fresh
                state = link[state]
            if state >= 0:
                child = step[state][symbol]
                link[fresh] = child if length[child] == length[state] + 1 else self._split(state, symbol, child)
            last = fresh

    def match(self, sequence: Sequence[int]) -> tuple[list[int], list[int]]:
        """After each symbol: the state and the length of the longest suffix that is a known substring."""
        step, link, length = self.step, self.link, self.length
        state = size = 0
        states, sizes = [], []
        for symbol in sequence:
            child = step[state].get(symbol)
            while child is None and state:
                state = link[state]
                size = length[state]
                child = step[state].get(symbol)
            if child is None:
                size = 0
            else:
                state, size = child, size + 1
            states.append(state)
            sizes.append(size)
        return states, sizes

    def table(self, symbols: int) -> np.ndarray:
        """Dense transitions ``[state, symbol]``; -1 where there is none."""
        out = np.full((len(self.step), symbols), -1, dtype=np.int32)
        for state, moves in enumerate(self.step):
            if moves:
                out[state, list(moves)] = list(moves.values())
        return out
