"""Suffix automata of reference segments, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """All runs of symbols of the sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """The state of the longest run that ends in symbol behind `state`; cut off from `target` where that holds longer ones."""
        length = self.length[state] + 1
        if self.length[target] == length:
            return target
        clone = self._state(length, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        return clone

    def add(self, symbols: Sequence) -> None:
        last = 0
        for symbol in symbols:
            at = self.next[last].get(symbol)
            if at is not None:
                last = self._split(last, symbol, at)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            state = last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, symbol, self.next[state][symbol])
            last = new

    def statistics(self, symbols: Sequence) -> Iterator[int]:
        """For each position, the length of the longest run ending there that an added sequence holds."""
        state, length, edges = 0, 0, self.next
        for symbol in symbols:
            while state and symbol not in edges[state]:
                state = self.link[state]
                length = self.length[state]
            to = edges[state].get(symbol)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield length


def earlier_matches(segments: list[tuple[int, Sequence]], size: int) -> list[list[int]]:
    """For each segment (order, symbols), by order, the starts of its windows of `size` that stand in a segment of a lesser order."""
    automaton, out, waiting = SuffixAutomaton(), [], []
    for n, (order, symbols) in enumerate(segments):
        if waiting and segments[n - 1][0] != order:
            for earlier in waiting:
                automaton.add(earlier)
            waiting = []
        out.append([k - size + 1 for k, length in enumerate(automaton.statistics(symbols)) if length >= size])
        waiting.append(symbols)
    return out
