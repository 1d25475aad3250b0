"""Toxicity from bags of subwords.

A word is the average of the embeddings of its character n-grams (and of itself), hashed into
buckets; a window of words is the average of its words; a linear softmax over two classes judges
a window. Embeddings and softmax are trained jointly in numpy. A text is toxic unless none of its
windows is: 1 - score is the product of the windows' own. Unseen misspellings share n-grams with
words that were seen.

The model is fitted on the driver to a sample with a bound: of each class at most ``sample`` labelled
rows, those with the smallest hash, whose crc32(id as text) mod 5 is not 0; whole texts of them. Scores
use whole texts. Since the softmax is linear, one number for each bucket (its embedding times the
difference of the class weights) is all that is sent to executors, whatever the input's size.

Edge cases: null or empty texts score 0; without labelled rows of both classes all score 0; if a
row is labelled twice the higher label counts; one row out for each row in; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow, sampled
from .language_id import held_out

BITS = 17
GRAMS = (3, 4, 5)
WINDOW = 16
REMEMBERED = 200_000
SCHEMA = "doc_id long, score double, predicted int"
#: ASCII characters that part words.
BLANKED = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(BLANKED).split()


def subwords(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words one after another, and how many each word has."""
    lengths = np.array([len(w) for w in found], np.int64)
    counts = 1 + sum(np.maximum(lengths + 3 - n, 0) for n in GRAMS)
    at = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()), np.int32)
    for length in np.unique(lengths):
        chosen = np.flatnonzero(lengths == length)
        raw = np.frombuffer(b"".join(found[i] for i in chosen), np.uint8).reshape(len(chosen), length)
        marked = np.pad(raw, ((0, 0), (1, 1)), constant_values=1).astype(np.uint32) + np.uint32(1)
        parts = []
        for n in (*GRAMS, length + 2):
            if (width := length + 3 - n) <= 0:
                continue
            h = np.full((len(chosen), width), n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ marked[:, k : k + width]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            parts.append((h >> np.uint32(32 - BITS)).astype(np.int32))
        block = np.concatenate(parts, axis=1)
        flat[at[chosen][:, None] + np.arange(block.shape[1])] = block
    return flat, counts


@dataclass
class Model:
    """For each bucket its part in a window's logit, and what is added."""

    weights: np.ndarray
    bias: float

    def of_words(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        flat, counts = subwords(found)
        return np.add.reduceat(self.weights[flat].astype(float), np.cumsum(counts) - counts) / counts

    def of_text(self, values: np.ndarray) -> float:
        """The score of a text whose words have these values."""
        if not len(values):
            return 0.0
        starts = np.arange(0, len(values), WINDOW)
        z = np.add.reduceat(values, starts) / np.minimum(WINDOW, len(values) - starts) + self.bias
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fit(texts: list[str], toxic: list[int], size: int = 8, rounds: int = 250, rate: float = 0.05, seed: int = 7) -> Model:
    """Embeddings and softmax trained jointly, all rows in each round, with Adam.

    Each window's gradient is one number g (times the class weights for the embeddings, times
    the embeddings for the class weights), so that a round adds up numbers by bucket.
    """
    split = [(tokens(t), y) for t, y in zip(texts, toxic, strict=True)]
    split = [(w, y) for w, y in split if w]
    if len({y for _, y in split}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for words, _ in split for w in words])
    flat, counts = subwords(list(index))
    word_at = np.cumsum(counts) - counts
    sizes = np.array([len(w) for w, _ in split])
    pieces = -(-sizes // WINDOW)
    doc_at = np.cumsum(pieces) - pieces
    first = np.cumsum(sizes) - sizes
    win_at = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(doc_at, pieces)) * WINDOW
    width = np.diff(np.append(win_at, len(ids)))
    token_win = np.repeat(np.arange(len(win_at)), width)
    y = np.array([t for _, t in split], float)
    weigh = np.where(y == 1, 0.35 / y.mean(), 0.65 / (1 - y.mean())) / len(y)  # false alarms cost more

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BITS, size)).astype(np.float32)
    soft = rng.normal(0, 1, (2, size)).astype(np.float32)
    bias = np.array([0.0, -3.0], np.float32)
    used = np.unique(flat)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    flat_used = place[flat]
    params = [emb[used], soft, bias]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        e, s, b = params
        d = s[1] - s[0]
        per_word = np.add.reduceat((e @ d).astype(float)[flat_used], word_at) / counts
        z = np.add.reduceat(per_word[ids], win_at) / width + float(b[1] - b[0])
        calm = np.add.reduceat(np.logaddexp(0, z), doc_at)  # -log(1 - score)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        slope = np.where(y == 1, -np.exp(-calm) / np.maximum(-np.expm1(-calm), 1e-9), 1.0) * weigh
        g = np.repeat(slope, pieces) * p
        g_word = np.bincount(ids, (g / width)[token_win], len(index)) / counts
        g_bucket = np.bincount(flat_used, np.repeat(g_word, counts), len(used)).astype(np.float32)
        g_d = g_bucket @ e
        total = np.float32(g.sum())
        grads = [g_bucket[:, None] * d + 1e-6 * e, np.stack([-g_d, g_d]), np.array([-total, total], np.float32)]
        for k, grad in enumerate(grads):
            mean[k] += 0.1 * (grad - mean[k])
            var[k] += 0.01 * (grad * grad - var[k])
            params[k] = params[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    e, s, b = params
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = e @ (s[1] - s[0])
    return Model(weights, float(b[1] - b[0]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> Model:
    """The model for ``doc_id, text`` and ``doc_id, toxic``, from rows that aren't held out."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"), 5, 0))
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = sampled(marked, ["toxic"], "doc_id", sample, "toxic")
    # At most 2 * sample rows of two numbers, by construction. Of rows that share an id the first text counts.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row."""
    weights, bias = model.weights, model.bias

    def make():
        own = Model(weights, bias)
        known: dict[bytes, float] = {}

        def columns(batch: pa.RecordBatch) -> list:
            scores: list[float] = []
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 200):
                group = [tokens(t) for t in texts[k : k + 200]]
                new = list(set().union(*group).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(set().union(*group))
                known.update(zip(new, own.of_words(new).tolist(), strict=True))
                scores += (own.of_text(np.array([known[w] for w in words])) for words in group)
            return [batch.column("doc_id"), scores, [int(x >= 0.5) for x in scores]]

        return columns

    return map_arrow(id_text(docs, id_col, text_col), make, SCHEMA)


def op2_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
