"""Consecutive parts of a text for code that runs inside container writers."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

# Fixed value: signs beside which a text may be parted.
_EDGES = frozenset(" \t\r\n,.;:!?，。！？；：、)]}）】》」』”’")


class Cuts:
    """The places of a text at which it may be parted, sorted once; every cut is then two searches among them."""

    def __init__(self, text: str):
        self.size = len(text)
        self.reach = min(16, max(4, self.size // 20))
        marked = [i for i, c in enumerate(text) if c in _EDGES]
        self.places = sorted({*marked, *(i + 1 for i in marked)} - {0})

    def near(self, target: int, floor: int) -> int:
        """The place nearest to target within reach and above floor, the lower of two as near; target itself if there is none."""
        if not floor < target < self.size:
            return min(max(target, floor), self.size)
        k = bisect_left(self.places, target)
        around = [i for i in self.places[max(0, k - 1) : k + 1] if i > floor and abs(i - target) <= self.reach]
        return min(around, key=lambda i: abs(i - target), default=target)


def shares(text: str, weights: list[int]) -> list[str]:
    """The text in consecutive parts of about the proportions of weights, each of which counts at least 1."""
    if not weights:
        return []
    upto = list(accumulate(max(1, w) for w in weights))
    cuts = Cuts(text)
    ends = list(accumulate((round(cuts.size * n / upto[-1]) for n in upto[:-1]), lambda last, at: cuts.near(at, last), initial=0))
    return [text[a:b] for a, b in zip(ends, [*ends[1:], cuts.size])]
