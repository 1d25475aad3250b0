"""Substring deduplication with a compressed FM-index for each shard.

A window is ``WINDOW`` consecutive words of a document. A word goes if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

Documents are cut into runs of windows that share a minimizer (the smallest hash of three words
inside the window); a run goes to the shard that its minimizer's hash names. Equal windows have
equal minimizers and so meet in one shard, each window is in one shard only, and shards are of
like sizes however many there are. A shard's index is built over its distinct runs, and its runs are
streamed through it: backward search over the wavelet matrix gives the matching statistics (cut at ``WINDOW``
words) with a step for each word, and the smallest document of the suffixes matched tells whether
a window is reported. Runs that share neither the words before nor those after their minimizer with another
run can match nothing and are left out of the index.

Words are compared by 64-bit hashes. A run that several documents of a chunk share is sent once, for the
smallest; for the others it is decided at once, and runs that recur are remembered for a task's further chunks. So a
passage that many documents share costs its shard a run or a few for each task, not for each document.

Edge cases: null or empty texts have no words; documents shorter than a window lose nothing;
rows with a null id are neither compared nor counted as a source; rows that repeat an id are one
document and don't take words from each other; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, perhaps_in, release, small_batches, stored
from .fm_index import FmIndex
from .wording import CHUNK, Runs, chunks, mixed, word_hashes, word_places

WINDOW = 13
GRAM = 3
#: Characters of documents for each shard, and bytes of text that are cut at once.
SHARD = 5_000_000
HELD = 1_500_000
#: Runs that recur in a task and are remembered.
RECURRING = 200_000
BIG = np.iinfo(np.int64).max
#: The low bits of a gram's hash, which give way to its place.
PLACES = (1 << 32) - 1
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Cut:
    """Runs of windows with one minimizer, of several documents' words: ``first`` and ``end`` in words, the minimizer's place
    in the run, and its hash."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        grams = words[: n - GRAM + 1]
        for k in range(1, GRAM):
            grams = mixed(grams + words[k : n - GRAM + 1 + k], k)
        # hash and place in one number, so that a sliding minimum gives both; the leftmost of equal ones counts
        low = (grams & ~np.uint64(PLACES)) | (np.arange(len(grams), dtype=np.uint64) & np.uint64(PLACES))
        width = 1
        while width < WINDOW - GRAM + 1:
            step = min(width, WINDOW - GRAM + 1 - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        window = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
        low = low[window]
        new = np.ones(len(window), bool)
        new[1:] = (low[1:] != low[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(new)
        self.first = window[at]
        self.end = window[np.append(at[1:], len(window)) - 1] + WINDOW if len(at) else at
        self.place = (low[at] & np.uint64(PLACES)).astype(np.int64) - (self.first & PLACES)
        self.minimizer = low[at] & ~np.uint64(PLACES)


#: What is sent of a run's document: id, digest of its text, first word, and which run.
OWNER = np.dtype([("doc", "<i8"), ("digest", "<u4"), ("first", "<i4"), ("run", "<i4")])
#: What is sent of a run that is decided: id, digest, first word and end.
DECIDED = np.dtype([("doc", "<i8"), ("digest", "<u4"), ("s", "<i4"), ("e", "<i4")])


def cut_runs(docs: DataFrame, shards: int) -> DataFrame:
    """``shard, places, owners, bytes`` of ``doc_id, h, text``: the distinct runs of a chunk of documents with sizes in bytes
    and minimizers' places, the smallest document that has each, and their words. Rows with a negative shard have
    windows that a smaller document of the chunk has too, in ``owners``."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        before: dict[int, int] = {}
        for batch in batches:
            ids = np.array([-1 if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
            known = np.array([x is not None for x in batch.column("doc_id").to_pylist()], bool)
            digests = batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint32)
            for a, b, data, offsets in chunks(batch.column("text"), HELD):
                made = list(sent(data, offsets, ids[a:b], known[a:b], digests[a:b], shards, squeeze, before))
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "places", "owners", "bytes"])
        release()

    return docs.select("doc_id", "h", "text").mapInArrow(run, "shard int, places binary, owners binary, bytes binary")


def sent(data, offsets, ids, known, digests, shards, squeeze, before):
    """The rows of a chunk of texts. ``before`` has the smallest document so far of runs that recur in a task, up to ``RECURRING``
    of them: they are sent again only for a smaller one."""
    starts, ends, counts = word_places(data, offsets)
    if len(starts) < WINDOW:
        return
    words = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    cut = Cut(words, np.where(known[doc], doc, -1 - np.arange(len(doc))))  # rows without an id have no windows
    if not len(cut.first):
        return
    begin = np.cumsum(counts) - counts
    owner = doc[cut.first]
    bodies, which = np.unique(Runs(words).of(cut.first, cut.end), return_inverse=True)
    order = np.lexsort((ids[owner], which))
    chosen = order[np.searchsorted(which[order], np.arange(len(bodies)))]  # of each body the run in the smallest document
    least = ids[owner[chosen]]
    names = bodies.tolist()
    earlier = np.array([before.get(b, BIG) for b in names], np.int64) if before else np.full(len(bodies), BIG)
    again = np.flatnonzero((np.bincount(which) > 1) | (earlier < BIG))
    for i in again.tolist():
        if len(before) < RECURRING or names[i] in before:
            before[names[i]] = min(int(least[i]), int(earlier[i]))
    fresh = (least < earlier)[which]  # with an earlier row of the same document or a smaller one there is nothing new
    least = np.minimum(least, earlier)[which]
    table = np.zeros(len(cut.first), OWNER)
    table["doc"], table["digest"], table["first"] = ids[owner], digests[owner], cut.first - begin[owner]
    shard = (mixed(cut.minimizer, 11) % np.uint64(shards)).astype(np.int64)
    stay = np.flatnonzero((ids[owner] == least) & (fresh | (ids[owner] == earlier[which])))
    order = stay[np.lexsort((which[stay], shard[stay]))]
    lo, hi = starts[cut.first], ends[cut.end - 1]
    raw = data.tobytes()
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        distinct, index = np.unique(which[part], return_inverse=True)
        rows = table[part]
        rows["run"] = index
        runs = chosen[distinct]
        sizes = (hi[runs] - lo[runs]).astype("<i4")
        text = b"".join([raw[s:e] for s, e in zip(lo[runs].tolist(), hi[runs].tolist(), strict=True)])
        yield int(shard[part[0]]), sizes.tobytes() + cut.place[runs].astype("u1").tobytes(), squeeze(rows.tobytes()), squeeze(text)
    gone = np.flatnonzero(ids[owner] != least)
    if len(gone):
        rows = np.zeros(len(gone), DECIDED)
        rows["doc"], rows["digest"], rows["s"], rows["e"] = ids[owner[gone]], digests[owner[gone]], table["first"][gone], table["first"][gone] + cut.end[gone] - cut.first[gone]
        yield -1 - int(mixed(words[:1])[0] % np.uint64(shards)), b"", squeeze(joined_spans(rows).tobytes()), b""


def joined_spans(rows: np.ndarray) -> np.ndarray:
    """Spans of one document that overlap or touch put together."""
    rows = rows[np.lexsort((rows["s"], rows["digest"], rows["doc"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["digest"][1:] != rows["digest"][:-1]) | (rows["s"][1:] > rows["e"][:-1])
    out = rows[new]
    if len(rows):
        out["e"] = np.maximum.reduceat(rows["e"], np.flatnonzero(new))
    return out


def may_share(words: Runs, first: np.ndarray, end: np.ndarray, place: np.ndarray, several: np.ndarray) -> np.ndarray:
    """The runs that may have a window in common with another run; those in ``several`` are in any case.

    A window holds its minimizer and ten words more: five or more before it, or five or more after
    it. So two runs with a common window have the minimizer with the five words before it in
    common, or with the five after it. The others can match nothing and are left out of the index.
    """
    half, at = (WINDOW - GRAM) // 2, first + place
    out = several.copy()
    for fits, a, b in ((place >= half, at - half, at + GRAM), (end - at - GRAM >= half, at, at + GRAM + half)):
        chosen = np.flatnonzero(fits)
        _, which, times = np.unique(words.of(a[chosen], b[chosen]), return_inverse=True, return_counts=True)
        out[chosen] |= times[which] > 1
    return out


def search_shard(table: pa.Table) -> pa.Table:
    """``doc_id, h, s, e``: words s to e of a document are to go."""
    unpack = zstandard.ZstdDecompressor().decompress
    done: list[np.ndarray] = []
    sizes, places, owners, texts, n = [], [], [], [], 0
    for place, owner, text in zip(*(table.column(c).to_pylist() for c in ("places", "owners", "bytes")), strict=True):
        if not place:
            done.append(np.frombuffer(unpack(owner), DECIDED))
            continue
        k = len(place) // 5
        sizes.append(np.frombuffer(place, "<i4", k))
        places.append(np.frombuffer(place, "u1", k, 4 * k))
        rows = np.frombuffer(unpack(owner), OWNER).copy()
        rows["run"] += n
        owners.append(rows)
        texts.append(unpack(text))
        n += k
    if n:
        done.append(shared_windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(sizes), np.concatenate(places).astype(np.int64), np.concatenate(owners)))
        release()
    rows = np.concatenate(done) if done else np.zeros(0, DECIDED)
    return pa.table({"doc_id": rows["doc"].copy(), "h": rows["digest"].astype(np.int64), "s": rows["s"].copy(), "e": rows["e"].copy()})


def hashed(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, chunk by chunk, and how many words each text has."""
    bounds = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    words, counts, first = [], [], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
        part = data[bounds[first] : bounds[last]]
        starts, ends, k = word_places(part, bounds[first : last + 1] - bounds[first])
        words.append(word_hashes(part, starts, ends))
        counts.append(k)
        first = last
    return np.concatenate(words), np.concatenate(counts)


def shared_windows(data: np.ndarray, sizes: np.ndarray, place: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Of all windows of a shard's runs, those which a smaller document has too, as spans."""
    words, counts = hashed(data, sizes)
    first = np.cumsum(counts) - counts
    # equal runs of several chunks are one
    sums = Runs(words)
    _, chosen, which = np.unique(sums.of(first, first + counts), return_index=True, return_inverse=True)
    body = which[owners["run"]]
    least = np.full(len(chosen), np.iinfo(np.int64).max)
    np.minimum.at(least, body, owners["doc"])
    most = np.full(len(chosen), np.iinfo(np.int64).min)
    np.maximum.at(most, body, owners["doc"])
    keep = np.flatnonzero(may_share(sums, first[chosen], first[chosen] + counts[chosen], place[chosen], least < most))
    if not len(keep):
        return np.zeros(0, DECIDED)
    del sums
    sizes, least = counts[chosen[keep]], least[keep]
    total = sizes + 1  # each run ends with a symbol that no window spans
    at = np.cumsum(total) - total
    run = np.repeat(np.arange(len(keep)), sizes)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    alphabet, symbols = np.unique(words[first[chosen[keep]][run] + inside], return_inverse=True)
    text = np.zeros(int(total.sum()), np.int64)
    text[at[run] + inside] = symbols + 1
    fm = FmIndex(text, len(alphabet) + 1, WINDOW, np.repeat(least, total))
    windows = sizes - WINDOW + 1
    base = np.cumsum(windows) - windows
    smallest = np.zeros(int(windows.sum()), np.int64)
    for run, start, group in fm.matches(text, at + sizes, sizes):
        smallest[base[run] + start] = fm.least[group]
    # every document that has a run asks for its windows
    back = np.full(len(chosen), -1)
    back[keep] = np.arange(len(keep))
    asks = owners[back[body] >= 0]
    asked = back[body[back[body] >= 0]]
    which = np.repeat(np.arange(len(asks)), windows[asked])
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows[asked]) - windows[asked], windows[asked])
    gone = smallest[base[asked][which] + start] < asks["doc"][which]
    which, start = which[gone], start[gone]
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(which)) - 1
    rows = np.zeros(len(a), DECIDED)
    if len(a):
        chosen = asks[which[a]]
        rows["doc"], rows["digest"], rows["s"], rows["e"] = chosen["doc"], chosen["digest"], chosen["first"] + start[a], chosen["first"] + start[b] + WINDOW
    return joined_spans(rows)


def covered(docs: DataFrame) -> DataFrame:
    """``doc_id, h, s, e``: words s to e of a document are to go; ``docs`` has ``doc_id, h, text`` where h tells apart texts of one id."""
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(16, math.ceil(chars / SHARD))
    small_batches(docs.sparkSession)
    found = cut_runs(docs, shards).groupBy("shard").applyInArrow(search_shard, "doc_id long, h long, s int, e int")
    return stored(found, "repeated-spans")


def remaining(text: str | None, spans: list | None) -> tuple[int, int, bytes]:
    """Number of words, of those that go, and the rest joined by spaces."""
    words = (text or "").encode("utf-8").split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for x in spans:
        gone[x["s"]] += 1
        gone[x["e"]] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)


def with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, text, spans``: spans are null for documents that lose nothing. Most of these go by without a shuffle."""
    texts = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    found = covered(texts)
    spans = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    some = perhaps_in(F.col("doc_id"), found.select("doc_id"))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    names = ["doc_id", "h", "text", "spans"]
    return texts.filter(some).join(spans, ["doc_id", "h"], "left").select(*names).union(texts.filter(~some).withColumn("spans", none).select(*names))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: the words that stay, joined by single spaces."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            rows = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            return [batch.column("doc_id"), [remaining(t, s)[2].decode("utf-8") for t, s in rows]]

        return columns

    return map_arrow(with_spans(docs, id_col, text_col), make, "doc_id long, text string")


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            rows = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            out = [(n, gone, hashlib.sha256(rest).hexdigest()) for n, gone, rest in (remaining(t, s) for t, s in rows)]
            return [batch.column("doc_id"), *(list(zip(*out, strict=True)) if out else [[]] * 3)]

        return columns

    return map_arrow(with_spans(docs, id_col, text_col), make, SCHEMA)
