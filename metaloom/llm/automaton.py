"""A generalised suffix automaton over word sequences."""

from __future__ import annotations


class SuffixAutomaton:
    """All word runs of a list of items; each state knows which items contain its runs.

    ``window`` is the length that counts as an occurrence; shorter items count whole.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[str]] = [set()]
        whole: list[tuple[str, list[str]]] = []
        for name, sequence in items:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add(name)
            if 0 < len(sequence) < window:
                whole.append((name, sequence))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0 and self.length[self.link[state]] >= window:
                ends[self.link[state]] |= ends[state]
        #: Items of the runs of window length that a state stands for.
        self.owners = [frozenset(x) for x in ends]
        #: Whole short items by the state of their run: (length, names).
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, sequence in whole:
            state = 0
            for word in sequence:
                state = self.next[state][word]
            self.short.setdefault(state, {}).setdefault(len(sequence), set()).add(name)
        self.least = min([window if len(s) >= window else len(s) for _, s in items if s], default=window)

    def _extend(self, last: int, word: str) -> int:
        there = self.next[last].get(word)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, there, word)
        new = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def _state(self, ways: dict[str, int], length: int) -> int:
        self.next.append(ways)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: str) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def stream(self, words: list[str]):
        """(position, longest match ending there, [(run length, items)]) for each position with an occurrence."""
        state, length = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                state, length = 0, 0
                continue
            found = []
            if length >= self.window:
                s = state
                while self.length[self.link[s]] >= self.window:
                    s = self.link[s]
                found.append((self.window, self.owners[s]))
            if self.short:
                s = state
                while s > 0:
                    for size, names in self.short.get(s, {}).items():
                        if size <= length:
                            found.append((size, names))
                    s = self.link[s]
            if found:
                yield i, length, found
