"""The share of matching parts of two sequences, equal to that of difflib.SequenceMatcher.

The longest match between two ranges is made of what the second sequence holds rarely. For small ranges each place where a longer one than
the longest so far can start is searched for. For large ones the places' runs of 1, 2, 4 ... items are numbered once, and ranges are asked
for the longest run in common, so work and memory grow with the ranges' lengths instead of their product.
"""

from __future__ import annotations

import sys
from bisect import bisect_left

import numpy as np

#: Fixed values of difflib: in sequences of FULL items or more, those that are more than a hundredth (and one) begin no match.
FULL, PART = 200, 100
#: Places in one range times items of the other beyond which runs are numbered.
LARGE = 3_000_000


def texts(a, b) -> tuple:
    """Lists as texts with a character for each member, if there are enough characters; texts as they are."""
    if isinstance(a, str):
        return a, b
    seen: dict = {}
    numbers = [[seen.setdefault(x, len(seen)) for x in s] for s in (a, b)]
    return tuple("".join(map(chr, n)) if len(seen) <= sys.maxunicode else n for n in numbers)


def codes(a, b) -> tuple[np.ndarray, np.ndarray, int]:
    """The items as whole numbers below the third value."""
    if isinstance(a, str):
        a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    both = np.concatenate([np.asarray(a, np.int64), np.asarray(b, np.int64)])
    top = int(both.max(initial=0))
    if top < 2 * len(both) + 1000:
        return both[: len(a)], both[len(a) :], top + 1
    names, numbers = np.unique(both, return_inverse=True)
    return numbers[: len(a)], numbers[len(a) :], len(names)


class Runs:
    """The places (in both sequences) of runs of `span` items that both hold, with the runs' numbers; -1 elsewhere."""

    def __init__(self, span: int, number: int, a: np.ndarray, b: np.ndarray):
        self.span, self.number, self.full = span, number, (a, b)
        self.places = [np.flatnonzero(x >= 0) for x in self.full]
        self.seen = np.zeros(number, bool)

    def keys(self, side: int, at: np.ndarray, more: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places `at` those where the run goes on for `more` items before `stop`, and the longer runs' names."""
        full = self.full[side]
        at = at[at + self.span + more <= stop]
        at = at[full[at + more] >= 0]
        return at, full[at] * self.number + full[at + more]

    def doubled(self) -> Runs | None:
        sides = [self.keys(s, self.places[s], self.span, len(self.full[s])) for s in (0, 1)]
        common = np.intersect1d(sides[0][1], sides[1][1])
        if not len(common):
            return None
        out = []
        for full, (at, keys) in zip(self.full, sides):
            new, place = np.full(len(full), -1, np.int64), np.searchsorted(common, keys).clip(max=len(common) - 1)
            ok = common[place] == keys
            new[at[ok]] = place[ok]
            out.append(new)
        return Runs(2 * self.span, len(common), *out)

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
        """The first longest run of span to 2 * span - 1 items inside the ranges."""
        inside = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi - self.span + 1)] for p, lo, hi in zip(self.places, (alo, blo), (ahi, bhi))]
        numbers = self.full[1][inside[1]]
        self.seen[numbers] = True
        at = inside[0][self.seen[self.full[0][inside[0]]]]
        self.seen[numbers] = False
        if not len(at):
            return None
        found, low, high = None, self.span, 2 * self.span - 1
        size = low
        while True:
            (at_a, keys_a), (at_b, keys_b) = self.keys(0, at, size - self.span, ahi), self.keys(1, inside[1], size - self.span, bhi)
            hit = np.isin(keys_a, keys_b)
            if hit.any():
                first, low = int(hit.argmax()), size
                found = int(at_a[first]), int(at_b[(keys_b == keys_a[first]).argmax()]), size
            else:
                high = size - 1
            if low >= high:
                return found
            size = (low + high + 1) // 2


class Matcher:
    def __init__(self, a, b):
        self.a, self.b = a, b = texts(a, b)
        x, y, self.number = codes(a, b)
        counts = np.bincount(y, minlength=self.number)
        rare = counts > 0
        if len(b) >= FULL:
            rare &= counts <= len(b) // PART + 1
        self.full = np.where(rare[x], x, -1), np.where(rare[y], y, -1)
        self.places = np.flatnonzero(self.full[0] >= 0).tolist()
        others = np.append(np.flatnonzero(self.full[0] < 0), len(a))
        #: For each place of a the end of its run of rare items.
        self.ends = others[np.searchsorted(others, np.arange(len(a)))].tolist()
        self.levels: list[Runs] | None = None

    def runs(self) -> list[Runs]:
        """Runs by falling length."""
        if self.levels is None:
            level, self.levels = Runs(1, self.number, *self.full), []
            while level is not None:
                self.levels.insert(0, level)
                level = level.doubled()
        return self.levels

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """Start in a, start in b and length of the longest run of rare items, the first in a and then in b."""
        here = self.places[bisect_left(self.places, alo) : bisect_left(self.places, ahi)]
        a, b, ends, best, size = self.a, self.b, self.ends, (alo, blo, 0), 1
        if not isinstance(a, str) or len(here) * (bhi - blo) > LARGE:
            return next((m for r in self.runs() if (m := r.longest(alo, ahi, blo, bhi))), best)
        for i in here:  # `size` is that of the next match, one longer than the best so far
            while i + size <= ends[i] and i + size <= ahi and (j := b.find(a[i : i + size], blo, bhi)) >= 0:
                best, size = (i, j, size), size + 1
        return best

    def matches(self) -> int:
        """The number of items of all matching blocks."""
        a, b, total, ranges = self.a, self.b, 0, [(0, len(self.a), 0, len(self.b))]
        while ranges:
            alo, ahi, blo, bhi = ranges.pop()
            i, j, k = self.longest(alo, ahi, blo, bhi)
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            if k:
                total += k
                if alo < i and blo < j:
                    ranges.append((alo, i, blo, j))
                if i + k < ahi and j + k < bhi:
                    ranges.append((i + k, ahi, j + k, bhi))
        return total


def ratio(a, b) -> float:
    """Twice the matching items over all; 1 for two empty sequences. Both are texts, or both lists of strings."""
    return 2.0 * Matcher(a, b).matches() / (len(a) + len(b)) if len(a) or len(b) else 1.0
