"""Matching blocks of two texts, those of ``difflib.SequenceMatcher`` without its junk rules, for many pairs at once.

The rule: the longest common block (the first in the one text, then in the other), and so on to the left and right of it. Here all
ranges that are left to match, of all pairs, take a step together: the length of each range's longest block by
halving, with names of power-of-two blocks that both texts have to compare places, and then all blocks of that length from left to
right, since the longest to the right of a block may be as long, but never to its left. What is left between them has
only shorter blocks, so steps are few: at most the square root of twice the text, some tens on any ordinary one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np

#: Characters that are matched together, or one longer pair.
GROUP = 1 << 18


class Ranges:
    """What is left to match: from ``a`` to ``a_end`` against ``b`` to ``b_end``, blocks of at most ``most``; places count through the whole group."""

    def __init__(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, most: np.ndarray) -> None:
        most = np.minimum(most, np.minimum(a_end - a, b_end - b))
        some = most > 0
        self.a, self.a_end, self.b, self.b_end, self.most = (v[some] for v in (a, a_end, b, b_end, most))

    def __len__(self) -> int:
        return len(self.a)


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, and which of them they belong to."""
    n = np.maximum(end - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - (np.cumsum(n) - n - start)[owner], owner


def equals(known: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows whose ``keys`` are among the ``known`` (in order) the columns, and which of them they equal."""
    at = np.searchsorted(known, keys)
    same = at < len(known)
    same[same] = known[at[same]] == keys[same]
    return *(c[same] for c in columns), at[same]


def common_names(numbers: np.ndarray, ends: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """For k from 0 on the names of the blocks of 2**k ``numbers`` that first and ``second`` texts have, by their first place, and -1 for other
    blocks and those that pass their end. Only the first texts are sorted; one more name (-1) stands after the last place."""
    levels: list[np.ndarray] = []
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    a_keys, b_keys = numbers[a], numbers[b]
    while True:
        known, names = np.unique(a_keys, return_inverse=True)
        b, found = equals(known, b_keys, b)
        if not len(b):
            return levels
        met = np.zeros(len(known), bool)
        met[found] = True
        level = np.full(len(numbers) + 1, -1, np.int32)
        level[a], level[b] = np.where(met[names], names, -1), found
        a, half = a[met[names]], 1 << len(levels)
        levels.append(level)
        a, b = (at[at + 2 * half <= ends[at]] for at in (a, b))
        a, b = (at[level[at + half] >= 0] for at in (a, b))
        a_keys, b_keys = (level[at].astype(np.int64) << 32 | level[at + half] for at in (a, b))


class Group:
    """Texts of some pairs behind each other, with names for the blocks that both texts of a pair have.

    ``there`` has the named places of all levels in order, a level behind the other (``level * width + place``): a short text against a long one
    has few, so that what a step holds and costs is not the long text again for each length that is tried.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]) -> None:
        texts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for pair in pairs for t in pair]
        sizes = np.array([len(t) for t in texts])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        numbers = np.concatenate(texts).astype(np.int64) | np.repeat(np.arange(len(texts)) // 2, sizes) << 21
        levels = common_names(numbers, np.repeat(bounds[1:], sizes), np.repeat(np.arange(len(texts)) % 2 > 0, sizes)) or [np.full(len(numbers) + 1, -1, np.int32)]
        self.width, depth = len(numbers) + 1, len(levels)
        self.names = np.empty(depth * self.width, np.int32)
        del numbers, texts
        for k in reversed(range(depth)):
            self.names[k * self.width : (k + 1) * self.width] = levels.pop()  # each is let go once it is copied
        self.there = np.flatnonzero(self.names >= 0)
        self.most = int(self.names.max()) + 1
        self.starts = bounds[:-1].reshape(-1, 2)
        longest = np.full(len(pairs), (2 << depth - 1) - 1)
        self.whole = (bounds[0:-1:2], bounds[1::2], bounds[1::2], bounds[2::2], longest)

    def keys(self, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the places from each start to its end those with a block of ``size`` that may be common, their owners, and the two names that make
        up the block as one number; some ``GROUP`` places at a time, in order."""
        level = np.frexp(size)[1].astype(np.int64) - 1
        row, back = level * self.width, size - (1 << level)
        left, right = np.searchsorted(self.there, row + start), np.searchsorted(self.there, row + np.maximum(end, start))
        cut, whose = spread(np.zeros(len(left), np.int64), (right - left + GROUP - 1) // GROUP)
        left, right = left[whose] + cut * GROUP, np.minimum(left[whose] + (cut + 1) * GROUP, right[whose])
        part = np.cumsum(right - left) // GROUP
        for some in np.split(np.arange(len(left)), np.flatnonzero(np.diff(part)) + 1):
            at, owner = spread(left[some], right[some])
            at, owner = self.there[at], whose[some][owner]
            second = self.names[at + back[owner]]
            kept = second >= 0
            at, owner = at[kept], owner[kept]
            yield at - row[owner], owner, self.names[at].astype(np.int64) * self.most + second[kept]

    def common(self, r: Ranges, which: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """First places, ranges (of ``which``) and numbers of the blocks of ``size`` in the first texts; then, some at a time, places, ranges and
        numbers of those in the other texts that equal one of the same range."""
        a, a_owner, a_key = (np.concatenate(v) for v in zip(*self.keys(r.a[which], r.a_end[which] - size + 1, size), strict=True))
        dense = None
        if self.most * self.most > (1 << 62) // max(len(which), 1):  # long texts: dense numbers first
            dense, a_key = np.unique(a_key, return_inverse=True)
        base = self.most * self.most if dense is None else len(dense)
        known, number = np.unique(a_owner * base + a_key, return_inverse=True)
        yield a, a_owner, number
        for b, owner, key in self.keys(r.b[which], r.b_end[which] - size + 1, size):
            if dense is not None:
                b, owner, key = equals(dense, key, b, owner)
            b, owner, number = equals(known, owner * base + key, b, owner)
            yield b, owner, number

    def longest(self, r: Ranges) -> np.ndarray:
        """The length of each range's longest common block."""
        low, high = np.zeros(len(r), np.int64), r.most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            has = np.zeros(len(open_), bool)
            for _, found, _ in islice(self.common(r, open_, middle), 1, None):
                has[found] = True
            low[open_[has]], high[open_[~has]] = middle[has], middle[~has] - 1
        return low

    def step(self, r: Ranges) -> tuple[np.ndarray, Ranges]:
        """The blocks (place, place, length) of the longest size in each range from left to right, and the ranges between them."""
        size = self.longest(r)
        which = np.flatnonzero(size > 0)
        size = size[which]
        (places, owners, numbers), *found = self.common(r, which, size)
        others, _, known = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(known, kind="stable")
        left, right = (np.searchsorted(known[order], numbers, side) for side in ("left", "right"))
        places, owners, left, right = (v[left < right] for v in (places, owners, left, right))
        sizes, a_starts, b_starts, others = (v.tolist() for v in (size, r.a[which], r.b[which], others[order]))
        taken, now = [], -1
        for i, o, lo, hi in zip(*(v.tolist() for v in (places, owners, left, right)), strict=True):
            if o != now:
                now, a_next, b_next, n = o, a_starts[o], b_starts[o], sizes[o]
            if i >= a_next and (k := bisect_left(others, b_next, lo, hi)) < hi:
                taken.append((i, others[k], n, o))
                a_next, b_next = i + n, others[k] + n
        made = np.array(taken, np.int64).reshape(-1, 4)
        i, j, n, o = made.T
        fresh = np.concatenate((np.ones(min(len(o), 1), bool), o[1:] != o[:-1]))  # the first of its range
        last = np.concatenate((fresh[1:], np.ones(min(len(o), 1), bool)))
        a_before, b_before = (np.where(fresh, s[which][o], np.concatenate(([0], v[:-1] + n[:-1])) if len(v) else v) for s, v in ((r.a, i), (r.b, j)))
        gaps = Ranges(*(np.concatenate(v) for v in ((a_before, (i + n)[last]), (i, r.a_end[which][o[last]]), (b_before, (j + n)[last]), (j, r.b_end[which][o[last]]), (n - 1, n[last] - 1))))
        return made[:, :3], gaps

    def blocks(self) -> list[np.ndarray]:
        left, found = Ranges(*self.whole), [np.empty((0, 3), np.int64)]
        while len(left):
            made, left = self.step(left)
            found.append(made)
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows[:, 0])]
        cuts = np.searchsorted(rows[:, 0], np.append(self.starts[:, 0], self.width))
        return [rows[cuts[k] : cuts[k + 1]] - [*self.starts[k], 0] for k in range(len(self.starts))]


def grouped(pairs: Sequence[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    now, total = [], 0
    for pair in pairs:
        n = len(pair[0]) + len(pair[1])
        if now and total + n > GROUP:
            yield now
            now, total = [], 0
        now.append(pair)
        total += n
    if now:
        yield now


def matching_blocks(pairs: Sequence[tuple[str, str]]) -> list[np.ndarray]:
    """For each pair its matching blocks, rows of place in the first text, place in the second and length, by place."""
    return [b for some in grouped(pairs) for b in Group(some).blocks()]
