"""Periodic runs: stretches of words that repeat with a period, found by names of power-of-two blocks.

Karp, Miller and Rosenberg's naming gives each block of 2**k words of a document a number, equal blocks the same
one, from pairs of the names of its halves. How far two places agree is then read off by descending levels. Every
run of at least ``LEAST`` words and three periods holds, for its period, a place of a grid at which four words agree
with those a period later; from such places runs are extended to both sides, for all documents of a group at once in numpy.

Blocks that occur once in their document have no name, so that ordinary text ends after a few levels. Time is
n log n a document, memory its words times the levels that repeats reach; documents are independent, and a group of short ones
holds ``GROUP`` words.

Edge cases: null texts and texts without words have no runs and an empty collapsed text; each row is judged by itself, rows that
share an id too; a row without an id is an ordinary one. Further columns are left out, an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow

#: Words and periods that a run has at least.
LEAST, PERIODS = 24, 3
#: Words of a document's start and period later that must agree at a place of the grid.
SEEN = 4
#: Words of the documents that are named together, and places of the grid that are looked at together.
GROUP, PLACES = 1 << 16, 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Numbers of words, equal words the same."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense names of ``keys``, and which of them occur more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names.astype(np.int32), counts[names] > 1


def named(numbers: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The names of all blocks of 2**k words, by their first word, for k from 0 on: -1 for those that occur once or pass
    the end of their document. ``numbers`` differ between documents; one more name (-1) stands after the last word."""
    levels: list[np.ndarray] = []
    at, keys = np.arange(len(numbers)), numbers
    while len(at):
        names, kept = again(keys)
        if not kept.any():
            break
        level = np.full(len(numbers) + 1, -1, np.int32)
        level[at[kept]] = names[kept]
        half = 1 << len(levels)
        levels.append(level)
        at = at[kept]
        at = at[at + 2 * half <= ends[at]]
        at = at[level[at + half] >= 0]
        keys = level[at].astype(np.int64) << 32 | level[at + half]
    return levels


def agreement(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, backward: bool = False) -> np.ndarray:
    """How many words from ``x`` and ``y`` on agree, or before them."""
    n, last = np.zeros(len(x), np.int64), len(levels[0]) - 1
    for k in reversed(range(len(levels))):
        far = -n - (1 << k) if backward else n
        a, b = x + far, y + far
        a, b = np.where((a < 0) | (a > last), last, a), np.where((b < 0) | (b > last), last, b)
        a, b = levels[k][a], levels[k][b]
        n += np.where((a == b) & (a >= 0), 1 << k, 0)
    return n


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of a document of n words, so that every run holds one of its own period: some million at a time.

    The words of a run that agree with those a period q later are max(2q, 24 - q) in sequence at least, so four of them
    begin at some multiple of three fewer.
    """
    periods = np.arange(1, n // PERIODS + 1)
    steps = np.maximum((PERIODS - 1) * periods, LEAST - periods) - SEEN + 1
    counts = np.maximum(0, (n - periods - SEEN) // steps + 1)
    sums = np.concatenate(([0], np.cumsum(counts)))
    first = 0
    while first < len(periods):
        end = max(first + 1, int(np.searchsorted(sums, sums[first] + PLACES, "right")) - 1)
        k = counts[first:end]
        which = np.repeat(np.arange(first, end), k)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)) * steps[which]
        yield place, periods[which]
        first = end


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) one for each stretch, with its smallest period: larger ones are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs (start, length, period) of each list of words, by start and then period."""
    sizes = np.array([len(w) for w in texts])
    bases = np.concatenate(([0], np.cumsum(sizes)))
    parts, known = [], 0
    for w in texts:
        parts.append(word_numbers(w) + known)
        known += len(w)
    levels = named(np.concatenate(parts), np.repeat(bases[1:], sizes)) if bases[-1] else []
    none = np.empty((0, 3), np.int64)
    by_text = [none]
    seen = SEEN.bit_length() - 1
    if len(levels) > seen:
        busy = np.unique(np.searchsorted(bases, np.flatnonzero(levels[seen] >= 0), "right") - 1)
        for d in busy[sizes[busy] >= LEAST]:
            mine = none
            for place, period in grid(int(sizes[d])):
                x = place + bases[d]
                name = levels[seen][x]
                x, period = (v[(name >= 0) & (name == levels[seen][x + period])] for v in (x, period))
                y = x + period
                start, end = x - agreement(levels, x, y, backward=True), y + agreement(levels, x, y)
                whole = end - start >= np.maximum(LEAST, PERIODS * period)
                mine = least_periods(np.concatenate((mine, np.stack((start, end, period), axis=1)[whole])))
            by_text.append(mine)
    found = np.concatenate(by_text)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cuts = np.searchsorted(found[:, 0], bases)
    made = [found[cuts[d] : cuts[d + 1]] for d in range(len(texts))]
    return [np.stack((r[:, 0] - b, r[:, 1] - r[:, 0], r[:, 2]), axis=1) for r, b in zip(made, bases, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([w for w, k in zip(words, np.cumsum(change), strict=False) if not k])


def groups(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Consecutive texts of ``GROUP`` words together, or one longer text."""
    now, total = [], 0
    for w in texts:
        if now and total + len(w) > GROUP:
            yield now
            now, total = [], 0
        now.append(w)
        total += len(w)
    if now:
        yield now


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each document: its runs by start, then period, and its words without the repeats,
    joined by spaces. ``change`` turns a document's words and id into the words to look at."""

    def start() -> Callable[[pa.RecordBatch], list]:
        def columns(batch: pa.RecordBatch) -> list:
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if change:
                texts = [change(w, i) for w, i in zip(texts, ids, strict=True)]
            runs, rest = [], []
            for some in groups(texts):
                for w, found in zip(some, runs_of(some), strict=True):
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                    rest.append(collapsed(w, found).decode())
            return [batch.column(0), [len(w) for w in texts], runs, rest]

        return columns

    given = id_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_arrow(given, start, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def tail_repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten with an end that repeats, as the query's contract asks."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """One row for each document: how many runs, the one with the largest exponent (exactly compared; the earliest, then the shortest
    period), and digests of all runs and of the collapsed text."""
    found = find_runs(docs, change=tail_repeated)
    larger = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, 1 << 30), F.col("runs")[0], lambda best, x: F.when(larger(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
