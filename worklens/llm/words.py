"""Words, lines and hashes of many texts at once, in numpy.

A text is UTF-8; words are runs of bytes other than space and 0x09 to 0x0D. Hashes are 64-bit
polynomials over bytes or words, taken from one running sum, so that the hash of any span
costs one subtraction. They stand for equality within one text or one group of candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse modulo 2**64; at least ``n``."""
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        pair = []
        for base in (BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS.clear()
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def running(values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` times growing powers, from which ``span_hash`` reads."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start])


@dataclass
class Words:
    data: np.ndarray      # bytes of all texts
    at: np.ndarray        # where each text begins, and the end
    doc: np.ndarray       # text of each word
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    hash: np.ndarray      # 64 bits of each word
    first: np.ndarray     # number of the first word of each text, and the total
    sums: np.ndarray      # running sums over the bytes

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def gram(self, n: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of runs of ``n`` words within one text, all or of those given; their hashes."""
        if starts is None:
            starts = np.arange(len(self.doc))
        starts = starts[starts + n <= len(self.doc)]
        starts = starts[self.doc[starts] == self.doc[starts + n - 1]]
        return starts, span_hash(self.word_sums, starts, starts + n)

    @cached_property
    def word_sums(self) -> np.ndarray:
        return running(self.hash)


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> Words:
    """The words of all texts; ``between`` tells which bytes part them."""
    space = between[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[at] = True
    inside = ~space
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(inside & (before | opens[:-1]))
    end = np.flatnonzero(inside & (after | opens[1:])) + 1
    doc = np.searchsorted(at, start, "right") - 1
    sums = running(data.astype(np.uint64) + np.uint64(1))
    first = np.searchsorted(start, at)
    return Words(data, at, doc, start, end, span_hash(sums, start, end), first, sums)


def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Repeats:
    """Keys met twice or more: their places in order of the key, then of the place."""
    place: np.ndarray     # places whose key repeats
    group: np.ndarray     # number of the key
    later: np.ndarray     # not the first place of its key
    count: np.ndarray     # places of each key
    first: np.ndarray     # first place of each key


def repeats(keys: np.ndarray) -> Repeats:
    """Places of the repeated keys. A count by leading bits spares the others the sort."""
    bits = max(10, (4 * len(keys)).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    place = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    place = place[np.argsort(keys[place], kind="stable")]
    found = keys[place]
    opens = np.ones(len(found), bool)
    opens[1:] = found[1:] != found[:-1]
    group = np.cumsum(opens) - 1
    count = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    held = count[group] > 1
    place, group, later = place[held], group[held], ~opens[held]
    _, group = np.unique(group, return_inverse=True)
    return Repeats(place, group, later, count[count > 1], place[~later])
