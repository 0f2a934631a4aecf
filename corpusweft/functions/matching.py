"""How many characters of two texts match in order, exactly as ``difflib.SequenceMatcher`` counts them, but sooner.

The longest common stretch is looked for (of equal ones the first in the first text, then in the second), and then on either
side of it, until nothing is left. The places at which two texts have the same character are the bits of one number, a row
for each character of the first text, so a stretch goes on where the number meets itself a row and a place further on. Where
the second text has 200 characters or more, difflib starts no stretch at a frequent character, so the few places of the
others are enough.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

#: From so many characters of the second text on, difflib leaves out frequent ones.
AUTOJUNK = 200


class Second:
    """The second text, which may meet many first ones."""

    def __init__(self, y: str) -> None:
        self.y, self.counts = y, Counter(y)
        self.long = len(y) >= AUTOJUNK
        self.width = len(y) // 8 + 1  # a bit that no place has stays free in each row
        seldom = (c for c, n in self.counts.items() if not self.long or n <= len(y) // 100 + 1)
        self.places = {c: _places(y, c) for c in seldom}
        if not self.long:
            self.rows = {c: sum(1 << j for j in js).to_bytes(self.width, "little") for c, js in self.places.items()}

    def matching(self, x: str) -> int:
        """The sum of ``SequenceMatcher(None, x, y).get_matching_blocks()``."""
        return self._of_seldom(x) if self.long else self._of_all(x)

    def ratio(self, x: str) -> float:
        both = len(x) + len(self.y)
        return 2.0 * self.matching(x) / both if both else 1.0

    def _of_all(self, x: str) -> int:
        none = bytes(self.width)
        row = 8 * self.width
        todo = [(int.from_bytes(b"".join([self.rows.get(c, none) for c in x]), "little"), len(x), 0, len(self.y))]
        total = 0
        while todo:
            table, n, low, high = todo.pop()
            if not table:
                continue
            ends, size = table, 1
            while longer := (ends << (row + 1)) & table:
                ends, size = longer, size + 1
            i, j = divmod((ends & -ends).bit_length() - 1, row)
            i, j = i + 1, j + 1
            total += size
            if i > size and j - size > low:
                todo.append((table & ((1 << (i - size) * row) - 1) & self._between(low, j - size, i - size), i - size, low, j - size))
            if i < n and j < high:
                todo.append(((table >> i * row) & self._between(j, high, n - i), n - i, j, high))
        return total

    def _between(self, low: int, high: int, n: int) -> int:
        return int.from_bytes(((1 << high) - (1 << low)).to_bytes(self.width, "little") * n, "little")

    def _of_seldom(self, x: str) -> int:
        y, total = self.y, 0
        met = sorted((i, js) for c, js in self.places.items() for i in _places(x, c))
        at = [i for i, _ in met]
        todo = [(0, len(x), 0, len(y))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, size = alo, blo, 0
            before, last = {}, -2
            for k in range(bisect_left(at, alo), bisect_left(at, ahi)):
                p, js = met[k]
                above, before = before if p == last + 1 else {}, {}
                last = p
                for q in js:
                    if q < blo:
                        continue
                    if q >= bhi:
                        break
                    before[q] = run = above.get(q - 1, 0) + 1
                    if run > size:
                        i, j, size = p - run + 1, q - run + 1, run
            while i > alo and j > blo and x[i - 1] == y[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and x[i + size] == y[j + size]:
                size += 1
            total += size
            if size and alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if size and i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
        return total

    def common(self, x: dict[str, int]) -> int:
        """Characters in common in any order, of the counts of another text."""
        own = self.counts
        return sum(min(n, own[c]) for c, n in x.items() if c in own)

    def at_most(self, x: str) -> int:
        """Characters in common in order at most: the longest common subsequence, where the text is short enough to tell soon."""
        rows, full = self._numbers(), (1 << len(self.y)) - 1
        left = full
        for c in x:
            met = left & rows.get(c, 0)
            left = ((left + met) | (left - met)) & full
        return len(self.y) - left.bit_count()

    def _numbers(self) -> dict[str, int]:
        if not hasattr(self, "numbers"):
            self.numbers = {c: sum(1 << j for j in _places(self.y, c)) for c in self.counts}
        return self.numbers


def _places(text: str, c: str) -> list[int]:
    out, at = [], text.find(c)
    while at >= 0:
        out.append(at)
        at = text.find(c, at + 1)
    return out


def ratios(xs: list[str], ys: list[str]) -> list[float]:
    """``SequenceMatcher(None, x, y).ratio()`` of each pair; equal second texts best stand together."""
    out, second = [], Second("")
    for x, y in zip(xs, ys):
        if second.y != y:
            second = Second(y)
        out.append(second.ratio(x))
    return out
