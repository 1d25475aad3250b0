"""Secret scans by a worklist of decoded layers.

Three kinds of spans are found in a text, leftmost and non-overlapping for each kind:
``assign`` (password = ...), ``access`` (AKIA...) and ``hex``. The text is the first layer. A
layer that holds URL escapes, Unicode escapes, character references, base64 (at any alignment) or
UTF-16 read as bytes gives further layers; so do the compressed bytes of a layer. Layers are scanned
until none is new: a layer whose text was seen before, from the same characters of the first one,
is not taken again, so cycles end and each place of a repeated secret is found. Spans of
a decoded layer are mapped back to the characters of the text that they come from (for compressed
bytes: to all of these). Offsets count code points, ends are exclusive.

Edge cases: a null text counts as empty; one row out for each row in, repeated ids included; an
empty table gives an empty one; further columns are ignored. Compressed runs are unpacked through
all members or frames, each once, in windows of about ``max_unpacked`` bytes (16 MiB), each scanned. The guard
against compression bombs is 64 windows a document: a run beyond it, or one whose content can't be
cut into windows safely, has a span of the kind ``unread`` as a whole, and is redacted with it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow

KINDS = ("assign", "access", "hex")
#: The kind of a compressed run that wasn't read to its end; it counts as a secret as a whole.
UNREAD = "unread"
ORDER = (*KINDS, UNREAD)
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the greedy run of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
REFERENCE = re.compile(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: The shortest secret, 16 hex digits, takes LONG characters of base64; packed, SHORTEST at least.
LONG, SHORTEST = 22, 12
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")
#: Heads of gzip, zlib, bz2, xz and zstd, as bytes and in base64.
PACKED = re.compile(r"\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
PACKED_BASE64 = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo|[/_]Td6|KLUv")
#: Encoded bytes unpacked in a step, unpacked bytes of a piece, windows unpacked for a document, and
#: what windows share where one can't be cut outside of the characters of secrets and encodings.
STEP, PIECE, TOTAL, OVERLAP = 256, 1 << 20, 64, 1 << 16
INSIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\&#;{}\0"
#: A space that isn't part of an assignment, nor of wide characters.
BETWEEN = re.compile(r"(?<=[^:=\x20\0])\x20(?=[^:=\x20\0])")
LATIN1 = re.compile(r"[\x00-\xff]+")
#: UTF-16 and UTF-32 read byte by byte, little-endian and big-endian.
WIDE = [re.compile(f"(?:{unit}){{8,}}") for unit in (r"[^\0]\0", r"\0[^\0]", r"[^\0]\0{3}", r"\0{3}[^\0]")]

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[str, int, int]


def find(text: str) -> list[Span]:
    """The spans of one layer."""
    spans: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += (("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12)
    if max(map(len, text.split()), default=0) >= 16:
        if "AKIA" in text:
            spans += (("access", m.start(), m.end()) for m in ACCESS.finditer(text))
        spans += (("hex", m.start(), m.end()) for m in HEX.finditer(text))
    return spans


class Layer:
    """A text whose character i comes from characters starts[i] to ends[i] of the first one."""

    __slots__ = ("cut", "ends", "starts", "text", "unread", "whole")

    def __init__(self, text: str, starts=None, ends=None, whole: tuple[int, int] | None = None, cut: bool = False, unread: bool = False):
        """``whole``: where all characters come from, if it is the same for all; ``cut``: more
        follows in another layer; ``unread``: stands for what can't be read."""
        self.text, self.whole, self.cut, self.unread = text, whole, cut, unread
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def key(self) -> bytes:
        """A digest of the text and its mapping."""
        seen = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"))
        for places in (self.whole,) if self.whole else (self.starts, self.ends):
            seen.update(array("q", places).tobytes())
        seen.update(bytes([self.whole is not None, self.cut, self.unread]))
        return seen.digest()

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self.whole or (self.starts[start], self.ends[end - 1])  # neither ever falls

    def replaced(self, pieces: list[tuple[int, int, str, list[int] | None]]) -> Layer:
        """With [start, end) replaced by other text. The list has, for each new character, the
        place in the run from which it comes, with the run's length at its end; None: the whole."""
        if self.whole:
            cuts = [0, *(x for s, e, *_ in pieces for x in (s, e)), len(self.text)]
            kept = [self.text[a:b] for a, b in list(pairwise(cuts))[::2]]
            return Layer("".join(x for pair in zip(kept, [*(p[2] for p in pieces), ""], strict=True) for x in pair), whole=self.whole, cut=self.cut)
        text, starts, ends, at = [], [], [], 0
        for s, e, new, cuts in pieces:
            text += (self.text[at:s], new)
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            whole = self.back(s, e)
            for i in range(len(new)):
                a, b = whole if cuts is None else self.back(s + cuts[i], s + cuts[i + 1])
                starts.append(a)
                ends.append(b)
            at = e
        text.append(self.text[at:])
        return Layer("".join(text), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])


def opened(head: bytes):
    """A decompressor for bytes that begin so; None if they aren't compressed."""
    if head.startswith(b"\x1f\x8b\x08"):
        return zlib.decompressobj(31)
    if head[:2] in (b"x\x01", b"x^", b"x\x9c", b"x\xda"):
        return zlib.decompressobj()
    if head.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if head.startswith(b"\xfd7zXZ\0"):
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    return zstandard.ZstdDecompressor().decompressobj() if head.startswith(b"\x28\xb5\x2f\xfd") else None


def unpacked(text: str, start: int, left: list[int]) -> Iterator[tuple[bytes, int, bool]]:
    """The content of the compressed bytes from ``start`` on, of all members or frames, piece by
    piece: bytes, where reading has come to, and whether the last member is whole. ``left`` holds
    how many bytes may still be unpacked."""
    at, d = start, None
    while at < len(text):
        raw = LATIN1.match(text, at, min(at + STEP, len(text)))
        if not raw:
            break
        raw = raw[0].encode("latin-1")
        try:
            if d is None:
                while at > start and raw[:1] == b"\0":  # padding between members
                    raw, at = raw[1:], at + 1
                if not raw:
                    continue
                if (d := opened(raw)) is None:
                    return
            if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                out, more = d.decompress(raw, PIECE), lambda: not d.eof and not d.needs_input
            else:
                out, more = d.decompress(raw), lambda: False
            at += len(raw) - len(d.unused_data)
            while True:
                left[0] -= len(out)
                yield out, at, d.eof
                if left[0] < 0 or not more():
                    break
                out = d.decompress(b"", PIECE)
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            return
        if left[0] < 0:
            return
        if d.eof:
            d = None


def cut_place(text: str) -> int:
    """Where a text may be cut near its end: no secret or encoded run goes on from there. 0 where it may not."""
    last = 0
    for m in BETWEEN.finditer(text, max(0, len(text) - OVERLAP)):
        last = m.end()
    return max(last, len(text.rstrip(INSIDE)))


def windows(layer: Layer, start: int, window: int, left: list[int], read: list[int]) -> Iterator[Layer]:
    """Layers of at most about ``window`` characters each of unpacked content, cut where neither a
    secret nor an encoded run can go on. A part that can't be read, or can't be cut so, is marked.
    ``read`` gets the place up to which members have been read to their end, or given up."""
    parts: list[str] = []
    n, end, whole, cut, broken = 0, start, True, False, False

    def out(text: str, cut: bool) -> Layer:
        return Layer(text, whole=layer.back(start, max(end, start + 1)), cut=cut)

    for piece, end, whole in unpacked(layer.text, start, left):
        read[0] = end if whole else read[0]
        for k in range(0, len(piece), window):
            parts.append(piece[k : k + window].decode("latin-1"))
            n += len(parts[-1])
            if n >= window:
                text = "".join(parts)
                safe = cut_place(text)
                broken, cut = broken or not safe, True
                yield out(text[:safe] if safe else text, True)
                rest = text[safe:] if safe else text[-OVERLAP:]
                parts, n = [rest], len(rest)
    if n:
        yield out("".join(parts), False)
    # more than may be unpacked, one run longer than a window, or compressed bytes that the window before cuts
    if end > start and (broken or left[0] < 0 or (not whole and layer.cut and end == len(layer.text))):
        if left[0] < 0:
            end = read[0] = LATIN1.match(layer.text, start).end()
        yield Layer("", whole=layer.back(start, max(end, start + 1)), unread=True)


def base64_layers(layer: Layer, start: int, run: str) -> Iterator[Layer]:
    """The bytes of a run at each alignment: the encoded part may begin after a path or an escape."""
    sextets = run.replace("-", "+").replace("_", "/")
    for skip in range(4):
        n = len(run) - skip
        n -= n % 4 == 1
        if n < 2:
            break
        data = base64.b64decode(sextets[skip : skip + n] + "=" * (-n % 4))
        if layer.whole:
            yield Layer(data.decode("latin-1"), whole=layer.whole, cut=layer.cut)
            continue
        # byte k takes its bits from characters k*8//6 on, and ends where bit 8k+8 does
        at, k = start + skip, range(len(data))
        starts = [layer.starts[at + i * 8 // 6] for i in k]
        ends = [layer.ends[at + -(-(i + 1) * 8 // 6) - 1] for i in k]
        yield Layer(data.decode("latin-1"), starts, ends)


def deeper(layer: Layer, window: int, left: list[int]) -> Iterator[Layer]:
    """The layers that one unwrapping of ``layer`` gives. A byte becomes the character of its
    number, so that no bytes are lost; what is searched for is ASCII."""
    text = layer.text
    if "%" in text:
        pieces = [(*m.span(), binascii.unhexlify(m[0].replace("%", "")).decode("latin-1"), list(range(0, len(m[0]) + 1, 3))) for m in PERCENT.finditer(text)]
        if pieces:
            yield layer.replaced(pieces)
    if "\\" in text:
        pieces = []
        for m in ESCAPE.finditer(text):
            parts = [(x.start(), int(next(filter(None, x.groups())), 16)) for x in ONE_ESCAPE.finditer(m[0])]
            if all(c < 0x110000 for _, c in parts):
                raw = "".join(chr(c) for _, c in parts)
                new = raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
                pieces.append((*m.span(), new, [*(at for at, _ in parts), len(m[0])] if len(new) == len(parts) else None))
        if pieces:
            yield layer.replaced(pieces)
    if "&#" in text:
        pieces = [(*m.span(), html.unescape(m[0]), None) for m in REFERENCE.finditer(text)]
        if pieces:
            yield layer.replaced(pieces)
    if "\0" in text:
        for wide in WIDE:
            pieces = [(*m.span(), m[0].replace("\0", ""), list(range(0, len(m[0]) + 1, step))) for m in wide.finditer(text) if (step := len(m[0]) // (len(m[0]) - m[0].count("\0")))]
            if pieces:
                yield layer.replaced(pieces)
    read = [0]  # a member that an earlier one was read through isn't begun again
    for m in PACKED.finditer(text):
        if m.start() >= read[0]:
            yield from windows(layer, m.start(), window, left, read)
    if max(map(len, text.split()), default=0) >= SHORTEST:
        for m in BASE64.finditer(text):
            if len(m[0]) >= LONG or PACKED_BASE64.search(m[0]):
                yield from base64_layers(layer, m.start(), m[0])


class Cover:
    """Spans none of which lies in another, by place, so that both starts and ends rise."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        """Whether a span lies in one that was added."""
        i = bisect_right(self.starts, start)
        return i > 0 and end <= self.ends[i - 1]

    def add(self, start: int, end: int) -> None:
        if not self.holds(start, end):
            a, b = bisect_left(self.starts, start), bisect_right(self.ends, end)  # from a to b lie in it
            self.starts[a : max(a, b)], self.ends[a : max(a, b)] = [start], [end]


def scan(text: str | None, max_unpacked: int = 1 << 24) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and all spans with those of decoded layers."""
    text = text or ""
    base = ordered(find(text))
    if not any(x in text for x in ("%", "\\", "&#", "\0")) and max(map(len, text.split()), default=0) < SHORTEST:
        return base, base
    first = Layer(text)
    found, seen, left = set(base), {first.key()}, [TOTAL * max_unpacked]
    covers = {kind: Cover() for kind in KINDS}
    for kind, s, e in base:
        covers[kind].add(s, e)
    work = [deeper(first, max_unpacked, left)]
    while work:  # depth first, so that few layers are held at once
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        if (key := new.key()) in seen:
            continue
        seen.add(key)
        if new.unread:
            found.add((UNREAD, *new.whole))
            continue
        inside = set()
        for kind, s, e in find(new.text):
            span = (kind, *new.back(s, e))
            # What a replaced layer leaves as it was, or cuts short, is the base's own.
            if not covers[kind].holds(*span[1:]):
                inside.add(span)
        for kind, s, e in inside:
            covers[kind].add(s, e)
        found |= inside
        work.append(deeper(new, max_unpacked, left))
    return base, ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], ORDER.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    runs: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    cuts = [0, *(x for r in runs for x in r), len(text)]
    return mark.join(text[a:b] for a, b in list(pairwise(cuts))[::2])


def columns(batch: pa.RecordBatch) -> list:
    out = []
    for text in batch.column("text").to_pylist():
        base, every = scan(text)
        counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
        out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
    return [batch.column("doc_id"), *(list(zip(*out, strict=True)) if out else [[]] * 5)]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts by kind, a digest of its own spans and all spans."""
    return map_arrow(id_text(docs, id_col, text_col), lambda: columns, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by a mark; other columns unchanged."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, scan(t)[1]))

    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))
