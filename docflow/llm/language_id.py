"""Language identification by compression.

Each language has a zstandard dictionary of raw content: texts of that language. A text is
compressed with each of them, and the language whose dictionary gives the smallest result is the
prediction. The margin to the next one gives the score; where it is narrow, ``rejected`` is set
(the prediction stays, so that every text with a letter has one).

The dictionaries are learned from rows whose crc32(id as text) mod 4 is not 2, from a sample with
a bound: of each language at most ``sample`` rows, those with the smallest hash, whole texts of as many as
have ``dict_bytes`` together (one at least). Predictions use whole texts.

Edge cases: a null text, or one without letters, is ``und`` with score 0; rows without a language or an id
aren't learned from; without any learned language all is ``und``; ties go to the first language
by name, after those that hold more of the text's words; one row out for each row in; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_text, map_arrow

HELD_OUT = (4, 2)
LEVEL = 3
#: Bytes of an empty frame, and the margin from which the score is 1.
EMPTY = 9
FULL_MARGIN = 0.25
#: Bytes compressed at a time.
PIECE = 3000
BLANKED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def held_out(id_: Column, mod: int = HELD_OUT[0], rest: int = HELD_OUT[1]) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % mod == rest, F.lit(False))


def learn(rows: DataFrame, sample: int = 160, dict_bytes: int = 1 << 18) -> dict[str, bytes]:
    """A dictionary's raw content for each language of ``doc_id, text, lang``.

    The first pass reads ids, languages and sizes, and keeps the ``sample`` smallest hashes of each
    language (ranks are limited before rows are dealt, so a frequent language costs no more), as far as their
    texts together have ``dict_bytes``, one at least; the second reads these rows' whole texts. What
    reaches the driver grows with the number of languages only.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit("langid"))
    hashed = rows.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").withColumn("h", order)
    by_hash = W.partitionBy("lang").orderBy("h", "size")
    first = hashed.select("lang", "h", F.octet_length("text").alias("size")).withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= sample)
    taken = F.sum("size").over(by_hash.rowsBetween(W.unboundedPreceding, 0))
    limits = first.withColumn("taken", taken).filter((F.col("taken") <= dict_bytes) | (F.col("r") == 1)).groupBy("lang").agg(F.max("h").alias("most")).collect()
    if not limits:
        return {}
    chosen = reduce(or_, [(F.col("lang") == r["lang"]) & (F.col("h") <= r["most"]) for r in limits])
    parts = hashed.filter(chosen).groupBy("lang", "h").agg(F.min("text").alias("part")).collect()  # rows that share an id count once
    contents: dict[str, list[str]] = {r["lang"]: [] for r in limits}
    for r in sorted(parts, key=lambda r: (r["h"], r["part"])):
        contents[r["lang"]].append(r["part"])
    return {lang: letters("\n".join(found)) for lang, found in sorted(contents.items())}


def letters(text: str) -> bytes:
    """The words of a text in lower case, with ASCII signs and digits taken for spaces."""
    return b" ".join(text.lower().encode("utf-8").translate(BLANKED).split())


class Classifier:
    """Compressors by language."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.contents = contents
        self.compress = {}
        for lang, raw in contents.items():
            known = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # the library takes no smaller one
            known.precompute_compress(level=level)
            self.compress[lang] = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False).compress

    def predict(self, text: str | None, narrow: float) -> tuple[str, float, bool]:
        """Language, score and whether the margin was narrow."""
        if not text or not self.compress or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = letters(text)
        # Compressed in pieces: later parts of a long text would else be matched to its own start.
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)] or [b""]
        sizes = sorted((sum(len(c(p)) - EMPTY for p in pieces), lang) for lang, c in self.compress.items())
        best = sizes[0][0]
        tied = [lang for n, lang in sizes if n == best]
        if len(tied) > 1:  # very short texts: more of whose words are there decides
            tied.sort(key=lambda lang: (-sum(b" " + w + b" " in self.contents[lang] for w in set(raw.split())), lang))
        # sizes less those of an empty frame, so that short texts have margins too
        margin = (sizes[1][0] - best) / max(sizes[1][0], 1) if len(sizes) > 1 else 1.0
        return tied[0], min(1.0, margin / FULL_MARGIN), margin < narrow


def identify(docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row."""

    def make():
        classifier = Classifier(contents)

        def columns(batch: pa.RecordBatch) -> list:
            found = [classifier.predict(t, narrow) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id"), *(list(zip(*found, strict=True)) if found else [[]] * 3)]

        return columns

    return map_arrow(id_text(docs, id_col, text_col), make, SCHEMA)


def op7_rows(docs: DataFrame) -> DataFrame:
    seen = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = identify(docs, learn(seen))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
