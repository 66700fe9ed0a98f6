"""The longest block that two texts share, by a suffix automaton of the shorter one: time in proportion to both lengths."""

from __future__ import annotations


class Automaton:
    """All substrings of a text. A state is a set of substrings that end at the same places; ``size`` is its longest, ``back`` leads to
    the state of the longest suffix that ends at more places."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.back, self.size = [-1], [0]
        last = 0
        for c in text:
            last = self._add(last, c)

    def _state(self, following: dict[str, int], back: int, size: int) -> int:
        self.next.append(following)
        self.back.append(back)
        self.size.append(size)
        return len(self.size) - 1

    def _add(self, last: int, c: str) -> int:
        new = self._state({}, 0, self.size[last] + 1)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.back[at]
        if at < 0:
            return new
        held = self.next[at][c]
        if self.size[held] == self.size[at] + 1:
            self.back[new] = held
            return new
        # ``held`` has longer substrings too, which don't end here: the shorter ones get a state of their own.
        own = self._state(dict(self.next[held]), self.back[held], self.size[at] + 1)
        self.back[held] = self.back[new] = own
        while at >= 0 and self.next[at].get(c) == held:
            self.next[at][c] = own
            at = self.back[at]
        return new


def longest_common(text: str, part: str) -> tuple[int, int]:
    """Place in ``text`` and size of the longest block that both share; of equally long ones the first in ``text``. (0, 0) if they share none."""
    own = Automaton(part)
    following, back, size = own.next, own.back, own.size
    state = length = best = end = 0
    for i, c in enumerate(text, 1):
        while state and c not in following[state]:
            state = back[state]
            length = size[state]
        if c in following[state]:
            state = following[state][c]
            length += 1
            if length > best:
                best, end = length, i
        else:
            length = 0
    return end - best, best
