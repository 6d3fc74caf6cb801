"""Ratcliff-Obershelp similarity of two texts: the longest common block, then the same to
its left and to its right; twice the matched characters by all characters.

Blocks are found with a suffix automaton of the second text, so a pair costs what its texts
are long and not their product.  Of equally long blocks the first in the first text counts,
and there its first place in the second.  In texts of 200 and more characters, those that
make up more than a hundredth begin no block and only prolong one.
"""

from __future__ import annotations

from collections import Counter

#: Length from which frequent characters begin no block.
LONG = 200


class SuffixAutomaton:
    """All substrings of a text; every state knows where its strings end first."""

    def __init__(self, text: str, start: int, end: int, apart: frozenset[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at in range(start, end):
            c = text[at]
            if c in apart:
                # no block goes across: what follows begins anew
                last = 0
                continue
            last = self._extend(last, c, at)

    def _new(self, length: int, first: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _extend(self, last: int, c: str, at: int) -> int:
        there = self.next[last].get(c)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        state = self._new(self.length[last] + 1, at, {}) if there is None else None
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p < 0:
            return state
        q = self.next[p][c]
        if self.length[q] != self.length[p] + 1:
            clone = self._new(self.length[p] + 1, self.first[q], dict(self.next[q]))
            self.link[clone], self.link[q] = self.link[q], clone
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = clone
                p = self.link[p]
            q = clone
        if state is None:
            return q
        self.link[state] = q
        return state


def longest_block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, apart: frozenset[str] = frozenset()) -> tuple[int, int, int]:
    """``(i, j, n)``: the longest block that both ranges share."""
    found = SuffixAutomaton(b, blo, bhi, apart)
    state = size = 0
    i, j, best = alo, blo, 0
    for at in range(alo, ahi):
        c = a[at]
        while state and c not in found.next[state]:
            state = found.link[state]
            size = found.length[state]
        if c in found.next[state]:
            state = found.next[state][c]
            size += 1
        if size > best:
            best, i, j = size, at - size + 1, found.first[state] - size + 1
    while i > alo and j > blo and a[i - 1] == b[j - 1]:
        i, j, best = i - 1, j - 1, best + 1
    while i + best < ahi and j + best < bhi and a[i + best] == b[j + best]:
        best += 1
    return i, j, best


def matched(a: str, b: str) -> int:
    """Characters in all blocks."""
    apart = frozenset(c for c, n in Counter(b).items() if n > len(b) // 100 + 1) if len(b) >= LONG else frozenset()
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        i, j, n = longest_block(a, b, alo, ahi, blo, bhi, apart)
        if n:
            total += n
            if alo < i and blo < j:
                open_.append((alo, i, blo, j))
            if i + n < ahi and j + n < bhi:
                open_.append((i + n, ahi, j + n, bhi))
    return total


def ratio(a: str, b: str) -> float:
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
