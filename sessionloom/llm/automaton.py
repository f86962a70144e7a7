"""A generalised suffix automaton, and matching statistics against it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Automaton:
    """Suffix automaton of several sequences; state 0 is the root."""

    go: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int) -> int:
        self.go.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, q: int, c) -> int:
        twin = self._state(self.length[p] + 1)
        self.go[twin] = dict(self.go[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = twin
            p = self.link[p]
        return twin

    def extend(self, last: int, c) -> int:
        """The state of the sequence at `last` followed by c."""
        q = self.go[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def add(self, sequence) -> int:
        """The state of the whole sequence, whose longest string it is."""
        last = 0
        for c in sequence:
            last = self.extend(last, c)
        return last

    def step(self, state: int, length: int, c) -> tuple[int, int]:
        """Matching statistics: the longest suffix of what was read plus c that the automaton holds."""
        go = self.go
        while state and c not in go[state]:
            state = self.link[state]
            length = self.length[state]
        nxt = go[state].get(c)
        return (0, 0) if nxt is None else (nxt, length + 1)
