"""A generalised suffix automaton over sequences of small integers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class SuffixAutomaton:
    """Of all sequences given to add(). States know their longest length, their suffix link and, after mark(), which sequences
    their strings occur in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.owners: list[set[int]] = [set()]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        """A state for the strings of q that end the strings of p and token; q keeps the longer ones."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Sequence[int]) -> None:
        last = 0
        for token in sequence:
            q = self.next[last].get(token)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            last = new

    def mark(self, owner: int, sequence: Sequence[int]) -> int:
        """Notes owner at every state that holds a substring of the sequence; returns the state of the whole sequence."""
        at = 0
        for token in sequence:
            at = up = self.next[at][token]
            while up > 0 and owner not in self.owners[up]:
                self.owners[up].add(owner)
                up = self.link[up]
        return at

    def matches(self, sequence: Sequence[int], least: int) -> Iterator[tuple[int, int]]:
        """(end, state) wherever the longest match that ends there has `least` tokens or more; the state is that of the last
        `least` tokens. end is exclusive."""
        at = length = 0
        following, link, longest = self.next, self.link, self.length
        for end, token in enumerate(sequence, 1):
            while at and token not in following[at]:
                at = link[at]
                length = longest[at]
            step = following[at].get(token)
            if step is None:
                length = 0
                continue
            at, length = step, length + 1
            while longest[link[at]] >= least:
                at = link[at]
                length = longest[at]
            if length >= least:
                yield end, at
