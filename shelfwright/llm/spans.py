"""Disjoint stretches of a text, looked up by bisection."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable


class Taken:
    """Disjoint stretches (start, end)."""

    def __init__(self, spans: Iterable[tuple] = ()):
        self.starts, self.ends = [], []
        for i, j, *_ in sorted(spans):
            self.starts.append(i), self.ends.append(j)

    def hit(self, i: int, j: int) -> bool:
        """Whether a stretch overlaps i to before j."""
        k = bisect_right(self.ends, i)
        return i < j and k < len(self.starts) and self.starts[k] < j

    def add(self, i: int, j: int) -> None:
        k = bisect_left(self.starts, i)
        self.starts.insert(k, i), self.ends.insert(k, j)
