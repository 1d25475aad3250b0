"""Words of whole batches of texts at once: places and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken at a time; a longer text is taken alone.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 2048
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers for each salt."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


BYTE_POWERS = powers(0xC2B2AE3D27D4EB4F, LONG_WORD)
RUN_BASE = 0xD6E8FEB86659FD93


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array's values one after another, and where each begins and ends; nulls are empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, end, data, offsets`` for runs of texts of at most about ``size`` bytes."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words ``[^\\x20\\x09-\\x0D]+`` of texts, and how many each text has."""
    inside = ~BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = offsets[1:-1]
    before[bounds[bounds < len(data)]] = False
    after[bounds[bounds > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    short = np.minimum(sizes, LONG_WORD)
    first = np.cumsum(short) - short
    place = np.arange(int(short.sum())) - np.repeat(first, short)
    values = (data[np.repeat(starts, short) + place].astype(np.uint64) + np.uint64(1)) * BYTE_POWERS[place]
    found = mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64) * ODD)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return found


class Runs:
    """Hashes of any runs of consecutive words, from sums over prefixes."""

    def __init__(self, words: np.ndarray):
        scale = powers(RUN_BASE, len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * scale, out=self.sums[1:])
        self.back = powers(pow(RUN_BASE, -1, 1 << 64), len(words) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * ODD, 5)
