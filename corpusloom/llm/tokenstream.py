"""Identifiers of lines and of token spans, for many texts at once.

Texts are folded together: without letter case, amount or kind of white space or the value of
digit runs. A prefix sum of powers then gives the 64-bit hash of any stretch by two look-ups,
so that neither a line nor a span is ever built as a string.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# An odd multiplier, so that its powers have inverses modulo 2**64.
BASE = 6364136223846793005
INVERSE = pow(BASE, -1, 1 << 64)
#: Code points that are folded together at most, if no single text is longer.
CHUNK = 400_000

_powers: dict[str, np.ndarray] = {}


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1 to ``n`` of the multiplier and of its inverse."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.full(size, BASE, np.uint64), dtype=np.uint64)
            _powers["down"] = np.cumprod(np.full(size, INVERSE, np.uint64), dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """White space to a space, decimal digits to 0, for the planes that have any; line feeds stay."""
    table = np.arange(0x20000, dtype=np.uint32)
    for c in range(0x20000):
        s = chr(c)
        if s.isspace() and c != 10:
            table[c] = 32
        elif s.isdecimal():
            table[c] = 48
    return table


class Stream:
    """The folded code points of some texts, their lines that are not blank, and their tokens."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts).casefold()
        a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = _folding()
        a = np.where(a < len(table), table[np.minimum(a, len(table) - 1)], a)
        gap, digit = a == 32, a == 48
        again = np.zeros(len(a), bool)
        again[1:] = (gap[1:] & gap[:-1]) | (digit[1:] & digit[:-1])
        a = a[~again]
        feed, gap = a == 10, a == 32
        edge = np.zeros(len(a), bool)
        if len(a):
            edge[0], edge[-1] = True, True
            edge[1:] |= feed[:-1]
            edge[:-1] |= feed[1:]
        a = a[~(gap & edge)]
        self.points = a
        feeds = np.flatnonzero(a == 10)
        start = np.concatenate([[0], feeds + 1])
        end = np.concatenate([feeds, [len(a)]])
        counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
        page = np.repeat(np.arange(len(texts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
        number = np.arange(len(page)) - np.repeat(first, counts) + 1
        some = end > start if len(texts) else np.zeros(1, bool)
        self.start, self.end = start[some], end[some]
        self.page, self.number = page[some[: len(page)]], number[some[: len(page)]]
        up, self._down = power_table(len(a) + 1)
        self._sums = np.zeros(len(a) + 1, np.uint64)
        with np.errstate(over="ignore"):
            # a line feed within a span counts as a space
            np.cumsum((np.where(a == 10, np.uint32(32), a).astype(np.uint64) + np.uint64(7)) * up[: len(a)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each stretch of code points."""
        with np.errstate(over="ignore"):
            return mixed((self._sums[end] - self._sums[start]) * self._down[start]).view(np.int64)

    def line_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, line) of each token; ``line`` counts the lines that are not blank."""
        letter = (self.points != 32) & (self.points != 10)
        flips = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        start, end = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
        return start, end, np.searchsorted(self.end, start, side="right")


def chunks(texts: list[str | None]):
    """(numbers, texts) of the texts that are neither null nor empty, some at a time."""
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            if at and size + len(t) > CHUNK:
                yield at, [texts[j] for j in at]
                at, size = [], 0
            at.append(i)
            size += len(t)
    if at:
        yield at, [texts[j] for j in at]
