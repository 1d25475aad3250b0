"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by the tokenizer's pattern; each piece is encoded separately. A piece that is a
token itself is that token. The other distinct pieces of a batch are put into matrices by length,
one row each, padded. In each round every row merges its leftmost pair of the smallest rank;
pairs are looked up in an open-addressing hash table of all pairs whose bytes together are a
token. Rows without a pair left are taken out, and matrices shrink with their rows. Pieces of
over ``LONG`` bytes take a heap instead, which gives the same merges in n log n.

Edge cases: a null text counts as empty and has no tokens; one row out for each row in; an empty
table gives an empty one; further columns are ignored. The rank file's path is a parameter; each
Python worker reads it once, so it must be at that path on every executor.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, map_arrow

NONE = np.int32(2**31 - 1)
LONG = 512
#: Bytes that matrices of one length may take in a go.
BLOCK = 1 << 20
#: Bytes of chunks with their ids that a worker remembers before it forgets all, chunks encoded at once, and
#: what a remembered chunk takes besides its characters and ids.
REMEMBERED = 48_000_000
AT_ONCE = 100_000
ENTRY = 200
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Ranks of token pairs in an open-addressing hash table with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(rank), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots = self.slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[slots] < 0
            at, first = np.unique(slots[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at] = keys[chosen]
            self.ranks[at] = rank[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, rank, slots = keys[rest], rank[rest], (slots[rest] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where there is none."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right).ravel()
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            slots = (self.slot(keys[open_]) + step) & (len(self.keys) - 1)
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[slots[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out.reshape(shape)


class ByteBpe:
    """A vocabulary of byte tokens by rank, as a ``.tiktoken`` file lists them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        triples = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        left, right, rank = (np.array(x, np.int64) for x in zip(*triples, strict=True)) if triples else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left, right, rank.astype(np.int32))
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.held = 0

    def merge_rows(self, ids: np.ndarray) -> list[bytes]:
        """The merged ids of rows of equal length, padded with -1 where rows are shorter."""
        out: list[bytes] = [b""] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        ranks[ids[:, 1:] < 0] = NONE
        while len(rows):
            if not ranks.shape[1]:
                done = np.ones(len(rows), bool)
                best = at = None
            else:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NONE
            if done.any():
                ready = ids[done]
                flat = ready[ready >= 0].astype("<u4").tobytes()
                ends = np.cumsum((ready >= 0).sum(axis=1) * 4).tolist()
                for r, s, e in zip(rows[done].tolist(), [0, *ends], ends, strict=False):
                    out[r] = flat[s:e]
                keep = ~done
                rows, ids, ranks = rows[keep], ids[keep], ranks[keep]
                if not len(rows):
                    break
                at, best = at[keep], best[keep]
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best  # a token's id is its rank
            shift = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            ranks = np.take_along_axis(ranks, shift[:, : width - 2] if width > 2 else shift[:, :0], axis=1)
            if width > 2:
                has_left = np.flatnonzero(at > 0)
                spot = at[has_left] - 1
                ranks[has_left, spot] = self.pairs.find(ids[has_left, spot], ids[has_left, spot + 1])
                has_right = np.flatnonzero(at < width - 2)
                spot = at[has_right]
                after = ids[has_right, spot + 1]
                ranks[has_right, spot] = np.where(after < 0, NONE, self.pairs.find(ids[has_right, spot], after))
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of pairs and a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        text = self.tokens
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = rank, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := self.ranks.get(text[ids[x]] + text[ids[y]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        made: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                made[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                made[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                # short pieces have a matrix for each length, longer ones share by eights
                width = len(raw) if len(raw) <= 16 else -(-len(raw) // 8) * 8
                if width in buckets:
                    buckets[width].append((piece, raw))
                else:
                    buckets[width] = [(piece, raw)]
        for width, members in buckets.items():
            rows = max(1, BLOCK // (width * 16))
            for k in range(0, len(members), rows):
                block = members[k : k + rows]
                flat = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in block]), np.uint8).reshape(len(block), width)
                lengths = np.array([len(raw) for _, raw in block])
                ids = np.where(np.arange(width) < lengths[:, None], self.single[flat], np.int32(-1))
                made.update(zip([piece for piece, _ in block], self.merge_rows(ids), strict=True))
        return made

    def encode_chunks(self, chunks: list[str], lead: str) -> None:
        """Remembers the ids of chunks, each with ``lead`` before it."""
        split = self.pattern.findall
        pieces = [split(lead + c) for c in chunks]
        made = self.encode_pieces(set().union(*pieces))
        get = made.__getitem__
        ids = [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in pieces]
        self.known[lead].update(zip(chunks, ids, strict=True))
        self.held += ENTRY * len(chunks) + sum(map(len, chunks)) + sum(map(len, ids))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        A text is first cut before each single space between other characters. No match of the
        pattern spans such a place, and none looks beyond it, so that equal chunks have equal
        pieces; a worker remembers the ids of chunks.
        """
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0

        def flush() -> None:
            wanted = {"": {c[0] for c in group}, " ": set().union(*(c[1:] for c in group))}
            if self.held > REMEMBERED:
                self.known, self.held = {"": {}, " ": {}}, 0
            for lead, chunks in wanted.items():
                self.encode_chunks(list(chunks.difference(self.known[lead])), lead)
            first, rest = self.known[""].__getitem__, self.known[" "].__getitem__
            out.extend(first(c[0]) + b"".join(map(rest, c[1:])) for c in group)

        for text in texts:
            group.append(chunked(text))
            held += len(group[-1])
            if held > AT_ONCE:
                flush()
                group, held = [], 0
        if group:
            flush()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunked(text: str) -> list[str]:
    """The text cut at its single spaces between other characters, without these spaces."""
    chunks = text.split(" ")
    if "" not in chunks and list(map(str.strip, chunks)) == chunks:
        return chunks
    out = [chunks[0]]
    for c in chunks[1:]:
        if not c or not out[-1] or c[0].isspace() or out[-1][-1].isspace():
            out[-1] += " " + c
        else:
            out.append(c)
    return out


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each text as an array."""

    def make():
        bpe = loaded(path, pattern)

        def columns(batch: pa.RecordBatch) -> list:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id"), [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(texts)]]

        return columns

    return map_arrow(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` of rows that :func:`encode` made."""

    def make():
        bpe = loaded(path, pattern)

        def columns(batch: pa.RecordBatch) -> list:
            ids = batch.column("ids").to_pylist()
            return [batch.column("doc_id"), [bpe.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in ids]]

        return columns

    return map_arrow(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes decoded from them, in one pass."""

    def make():
        bpe = loaded(path, pattern)

        def columns(batch: pa.RecordBatch) -> list:
            ids = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            return [
                batch.column("doc_id"),
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            ]

        return columns

    return map_arrow(id_text(docs, id_col, text_col), make, SCHEMA)


def op4_rows(docs: DataFrame) -> DataFrame:
    return token_digests(docs, *default_vocabulary())
