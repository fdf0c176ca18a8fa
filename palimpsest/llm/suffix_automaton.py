"""Suffix automata over sequences of integers (bytes, or hashes of words)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the sequences added to it.

    ``owner`` of a state is the owner given with the first sequence that holds the
    state's substrings; adding in ascending order of owners, it is the least one.
    """

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner = [-1]
        for s in sequences:
            self.add(s)

    def add(self, sequence: Sequence[int], owner: int = 0) -> None:
        step, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is None:
                new = len(link)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                owners.append(owner)
                p = last
                while p != -1 and (q := step[p].get(c)) is None:
                    step[p][c] = new
                    p = link[p]
                if p != -1:
                    link[new] = q if length[p] + 1 == length[q] else self._clone(p, c, q)
                last = new
            else:
                last = q if length[last] + 1 == length[q] else self._clone(last, c, q)

    def _clone(self, p: int, c: int, q: int) -> int:
        """A state for the shorter substrings of q, those that c leads to from p."""
        step, link = self.next, self.link
        copy = len(link)
        step.append(dict(step[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(self.owner[q])
        link[q] = copy
        while p != -1 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def state(self, sequence: Sequence[int]) -> int:
        """The state of a substring."""
        at = 0
        for c in sequence:
            at = self.next[at][c]
        return at

    def owners(self, sequence: Sequence[int], size: int) -> list[int]:
        """Matching statistics: of each ``size`` items in a row, the owner of their first occurrence, or -1."""
        step, link, length = self.next, self.link, self.length
        out, state, matched = [], 0, 0
        for i, c in enumerate(sequence):
            q = step[state].get(c)
            while q is None and state:
                state = link[state]
                matched = length[state]
                q = step[state].get(c)
            if q is not None:
                state, matched = q, matched + 1
            if i + 1 >= size:
                if matched >= size:
                    while length[link[state]] >= size:
                        state = link[state]
                        matched = length[state]
                    out.append(self.owner[state])
                else:
                    out.append(-1)
        return out
