"""A compressed index of an integer sequence: its BWT in a wavelet matrix of packed bits, and the borders of
groups of suffixes that begin alike, as bits too. The suffix array isn't kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BitRank:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        counts = np.bitwise_count(self.words)
        np.cumsum(counts[:-1], out=self.before[1:])
        self.ones = int(self.before[-1]) + int(counts[-1])

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        held = self.words[word]
        below = held & ((np.uint64(1) << shift) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below), (held >> shift) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return self.look(at)[0]


class WaveletMatrix:
    """Occurrences of a symbol before a place, in one bit rank for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[BitRank, int]] = []
        now = symbols
        for bit in range(self.depth - 1, -1, -1):
            bits = ((now >> bit) & 1).astype(bool)
            level = BitRank(bits)
            self.levels.append((level, len(now) - level.ones))
            now = np.concatenate([now[~bits], now[bits]])
        self.origin = self.descend(np.arange(size), np.zeros(size, np.int64))  # where each symbol's own part begins

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.descend(symbol, at) - self.origin[symbol]


class FmIndex:
    """Backward search with patterns of up to ``depth`` symbols (9 to 16).

    ``values`` belong to the places of ``text``; ``least`` has the smallest one of each group of
    suffixes that begin with the same ``depth`` symbols. Suffixes are sorted by 16 symbols.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int, values: np.ndarray):
        n, self.depth = len(text), depth
        rank = text.astype(np.int64)
        for known in (1, 2, 4):
            rank = np.unique(paired(rank, known, max(n, size)), return_inverse=True)[1]
        suffixes = np.argsort(paired(rank, 8, n), kind="stable")
        self.bwt = WaveletMatrix(text[suffixes - 1], size)  # the first symbol is preceded by the last
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=self.first[1:])
        self.groups = BitRank(borders(rank, suffixes, depth - 8))
        shorter = borders(rank, suffixes, depth - 9)
        self.shorter, self.shorter_at = BitRank(shorter), np.flatnonzero(shorter).astype(np.int32)
        self.least = np.minimum.reduceat(values[suffixes], np.flatnonzero(borders(rank, suffixes, depth - 8)))

    def start(self, symbol: np.ndarray) -> np.ndarray:
        return self.first[symbol]

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search: from the first suffix of a match to that of the match with a symbol before it."""
        return self.first[symbol] + self.bwt.rank(symbol, at)

    def group(self, at: np.ndarray) -> np.ndarray:
        return self.groups.rank(at + 1) - 1

    def shortened(self, at: np.ndarray) -> np.ndarray:
        """From the first suffix of a match of ``depth`` symbols to that of its first ``depth - 1``."""
        return self.shorter_at[self.shorter.rank(at + 1) - 1]

    def matches(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of streamed runs, cut at ``depth``, from their last symbols to their first.

        A step lengthens the match of every run by the symbol before it; where it is ``depth`` long
        already, it is first shortened at its end. So each place takes one step, and the match
        there is ``depth`` long unless the run ends before. Given are, for each place with such a match, the
        run, the place in it, and the match's group of suffixes. Runs are those of the index: a match never
        fails, so that the first suffix of it is all that is needed.
        """
        run = np.argsort(-sizes, kind="stable")
        order = -sizes[run]
        at = np.zeros(0, np.int64)
        for step in range(int(sizes.max(initial=0))):
            run = run[: np.searchsorted(order, -step, "left")]  # those longer than the step
            symbol = text[ends[run] - 1 - step]
            if step == 0:
                at = self.start(symbol)
            else:
                at = at[: len(run)]
                at = self.extend(symbol, self.shortened(at) if step >= self.depth else at)
            if step >= self.depth - 1:
                yield run, sizes[run] - 1 - step, self.group(at)


def paired(rank: np.ndarray, ahead: int, most: int) -> np.ndarray:
    after = np.zeros(len(rank), np.int64)
    after[: max(len(rank) - ahead, 0)] = rank[ahead:] + 1
    return rank * (most + 2) + after


def borders(rank: np.ndarray, suffixes: np.ndarray, ahead: int) -> np.ndarray:
    """Whether a suffix differs from the one before in its first ``8 + ahead`` symbols; ``rank`` is by the first eight."""
    new = np.ones(len(suffixes), bool)
    own = rank[suffixes]
    later = np.full(len(rank), -1, np.int64)
    later[: len(rank) - ahead] = rank[ahead:]
    later = later[suffixes]
    new[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
    return new
