"""Importance resampling: documents drawn so that they look like a target corpus.

A document's features are its runs of one to ``ORDER`` words, hashed into ``BUCKETS`` buckets. A bucket's gain is the logarithm
of how much likelier it is in the target corpus than in the documents, a document's weight the mean gain of its features. Adding
Gumbel noise, fixed by the id, and taking the highest scores draws without replacement in proportion to the weights' exponentials.

Long texts don't stall a task: they are cut at word boundaries into chunks of ``OWNED`` words and dealt out anew. A chunk carries
the next ``ORDER`` - 1 words, and owns the features that start in its own part, so that each counts once; counts and sums of chunks are added up
by document. Short texts are chunks as they are and stay where they are read. The ranks come from a sort by range: what a
partition holds is counted, and the counts before it are added.

Edge cases: null texts and texts without words have no features, weight 0, and are never drawn; each row is drawn by
itself, rows that share an id have the same noise; a row without an id has the noise of the text ``null`` and loses ties.
An empty target leaves gains of the smoothing alone; an empty table gives an empty one. Further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, stored

ORDER, BUCKETS = 2, 10_000
#: Words that a chunk of a long text owns, and the bytes from which a text is long.
OWNED, LONG = 4096, 1 << 15
#: Words of a document that may be drawn, and the share of them that is, in hundredths.
LEAST_WORDS, SHARE = 20, 25
#: Lower case for A-Z, a space for each other byte of ASCII that isn't a letter or digit.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FEATURES = "row long, doc_id long, owned int, buckets array<smallint>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def chunks(words: list[bytes], owned: int, order: int = ORDER) -> list[list[bytes]]:
    """Parts of ``owned`` words, each with those of the next part that its last features need."""
    return [words[k : k + owned + order - 1] for k in range(0, len(words), owned)]


def buckets(words: list[bytes], owned: int, order: int = ORDER) -> np.ndarray:
    """The buckets of all runs of one to ``order`` words that start in the first ``owned`` ones."""
    sums = [zlib.crc32(w) for w in words]
    found = [sums[:owned]]
    following = [b" " + w for w in words[1:]]
    for k in range(1, order):
        sums = [zlib.crc32(w, s) for w, s in zip(following[k - 1 :], sums, strict=False)]
        found.append(sums[:owned])
    return (np.concatenate([np.array(s, np.int64) for s in found]) % BUCKETS).astype(np.int16)


def chunked(docs: DataFrame, words_owned: int) -> DataFrame:
    """``row, doc_id, owned, text`` of the chunks of long texts (``row, doc_id, text``), dealt to all tasks."""

    def start() -> Callable[[pa.RecordBatch], list]:
        def columns(batch: pa.RecordBatch) -> list:
            found = [
                (r, i, min(words_owned, len(w) - k * words_owned), b" ".join(part))
                for r, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                for w in [words_of(t)]
                for k, part in enumerate(chunks(w, words_owned) or [[]])
            ]
            return [list(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]

        return columns

    made = map_arrow(docs, start, "row long, doc_id long, owned int, text binary")
    return made.repartition(F.xxhash64("row", "text"))


def features(docs: DataFrame, words_owned: int = OWNED, long_bytes: int = LONG) -> DataFrame:
    """``row, doc_id, owned, buckets`` of all chunks: ``row`` tells the rows of ``docs`` apart. Texts of more than ``long_bytes`` are cut."""

    def start() -> Callable[[pa.RecordBatch], list]:
        def columns(batch: pa.RecordBatch) -> list:
            owned = batch.column(2).to_pylist()
            texts = [words_of(t) for t in batch.column(3).to_pylist()]
            owned = [len(w) if k is None else k for w, k in zip(texts, owned, strict=True)]
            found = [buckets(w, k) for w, k in zip(texts, owned, strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int16)))
            return [batch.column(0), batch.column(1), owned, lists]

        return columns

    text = F.col("text").cast("binary").alias("text")
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    short = rows.filter(~is_long).select("row", "doc_id", F.lit(None).cast("int").alias("owned"), text)
    long = chunked(rows.filter(is_long).select((-1 - F.col("row")).alias("row"), "doc_id", text), words_owned)
    return map_arrow(short.union(long), start, FEATURES)


def counted(found: DataFrame) -> DataFrame:
    """How often each bucket occurs: at most ``BUCKETS`` rows."""
    return stored(found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "bucket-counts", parts=1)


def gains(ours: DataFrame, target: DataFrame) -> DataFrame:
    """The gain of each bucket of ``ours`` in thousandths of a natural logarithm, counts smoothed by one: at most ``BUCKETS`` rows."""
    size = lambda counts: F.coalesce(counts.agg(F.sum("n").alias("n")).scalar(), F.lit(0)).cast("double") + BUCKETS
    both = ours.join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * size(ours) / ((F.col("n").cast("double") + 1) * size(target))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(found: DataFrame, gain: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight`` of each document: chunks added up; ``gain`` has a row a bucket."""
    each = found.select("row", "doc_id", "owned", F.posexplode_outer("buckets").alias("place", "bucket")).join(F.broadcast(gain), "bucket", "left")
    own = F.when(F.coalesce("place", F.lit(0)) == 0, F.col("owned").cast("long")).otherwise(0)
    sums = each.groupBy("row", "doc_id").agg(F.sum(own).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    divisor = F.greatest("n_features", F.lit(1))
    floor = F.call_function("div", F.col("total") - F.pmod("total", divisor), divisor)
    return sums.select("row", "doc_id", "n_words", "n_features", floor.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def drawn(scored: DataFrame) -> DataFrame:
    """``rank`` for the highest ``SHARE`` hundredths of the rows with enough words, ties to the smaller id; null for the others.

    Sorted by range, each row's place in its partition and the number of rows before the partition make its rank.
    """
    may = (F.col("n_words") >= LEAST_WORDS).cast("int")
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = scored.withColumn("may", may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, "ranged")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sums = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("may").alias("m")).orderBy("part").collect():  # a row a partition
        sums.append((r["part"], before, r["m"]))
        before += r["n"]
    most = sum(m for *_, m in sums) * SHARE // 100
    starts = placed.sparkSession.createDataFrame([s[:2] for s in sums], "part long, rows_before long")
    rank = inside + F.col("rows_before") + 1
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= most, rank))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, words_owned: int = OWNED, long_bytes: int = LONG) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each of ``docs``; those with a rank are drawn to look like ``target``
    (``text``), the likeliest first."""
    found = stored(features(id_text(docs, id_col, text_col), words_owned, long_bytes), "features")
    wanted = features(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), words_owned, long_bytes)
    weighed = weights(found, gains(counted(found), counted(wanted)))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")
