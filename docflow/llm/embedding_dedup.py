"""Near-duplicate embeddings by product quantisation.

Per label, coarse centroids (k-means on the sphere, fitted to a sample with a bound: those vectors of a label
with the smallest hash, ``sample`` of them or eight a list, ``all_samples`` over all labels) part the
vectors into inverted lists. In a
list a vector is kept as codes of its residual, one for each subspace, from codebooks fitted to
the sample's residuals, with the length of what the codes leave out. A query visits the lists
whose centroids are nearest, as many as ``probes`` or, by default, as many as a measurement on the sample shows to be enough. Its inner products with a list's vectors come
from lookup tables (one for each subspace); since the part left out can add no more than its
length, a table distance rules a vector out for certain or lets it through to the exact cosine in
double precision. Every vector is indexed and is a query.

Equal vectors are one entry with their number. A link counts for both of its ends, once: entries
and queries carry the lists that they visit, so that the task that finds a pair knows whether the
entry meets the query in the query's list too, and counts for the entry where it doesn't. What goes
on from a task are a count for each vector and a spanning forest of its links, not pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing; vectors of different lengths don't link; ties go to the
smaller id; repeated ids keep a row each; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, release, sampled, stored
from .components import components

THRESHOLD = 0.93
#: Vectors of a list, dimensions of a subspace, codes of a subspace.
LIST = 256
SUBSPACE = 8
CODES = 64
#: Lists of a label and dimension at most.
LISTS = 8192
#: Entries of a list that a task holds at once (and four times as many queries).
BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v`` (doubles) of the vectors that can link."""
    typed = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    return typed.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite & nonzero)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3, sphere: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centers.T - 0.5 * (centers**2).sum(1)).argmax(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        filled = counts > 0
        centers[filled] = sums[filled] / counts[filled, None]
        if sphere:
            norms = np.linalg.norm(centers, axis=1, keepdims=True)
            centers = np.where(norms > 1e-12, centers / np.maximum(norms, 1e-12), centers)
    return centers


class Quantiser:
    """Coarse centroids and residual codebooks of one label and dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists, sphere=True)
        near = (sample @ self.coarse.T).argmax(1)
        residual = sample - self.coarse[near]
        dim = sample.shape[1]
        self.cuts = [(s, min(s + SUBSPACE, dim)) for s in range(0, dim, SUBSPACE)]
        self.books = [kmeans(residual[:, s:e], CODES) for s, e in self.cuts]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        scores = x @ self.coarse.T
        n = min(n, scores.shape[1])
        part = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        order = np.take_along_axis(scores, part, 1).argsort(axis=1)[:, ::-1]
        return np.take_along_axis(part, order, 1)

    def sufficient(self, x: np.ndarray, cosine: float = THRESHOLD, share: float = 0.97, least: int = 8, most: int = 64) -> int:
        """Lists to visit, as measured: of copies of a sample moved to ``cosine`` in any direction, ``share`` at least
        have the original's list among those that they visit, or the original has theirs."""
        x = x[:: max(1, len(x) // 1000)]
        noise = np.random.default_rng(11).normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        moved = cosine * x + math.sqrt(1 - cosine**2) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        there, back = self.nearest(moved, most), self.nearest(x, most)
        met = np.minimum((there == back[:, :1]).argmax(1) + most * ~(there == back[:, :1]).any(1), (back == there[:, :1]).argmax(1) + most * ~(back == there[:, :1]).any(1))
        return int(np.clip(np.quantile(met, share, method="higher") + 1, least, most))

    def encode(self, x: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to a centroid, and the length that they leave out."""
        residual = x - self.coarse[which]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        left = np.zeros(len(x))
        for k, ((s, e), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, s:e]
            codes[:, k] = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            left += ((part - book[codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, s:e] @ book.T for (s, e), book in zip(self.cuts, self.books, strict=True)]


def fit(entries: DataFrame, least: int, total: int, probes: int | None) -> dict[tuple[str, int], Quantiser]:
    """A quantiser for each label and dimension, from a sample of at most ``least`` vectors or eight a list, as far as all
    samples together have ``total`` (or ``least`` each).

    Lists grow in number with a label's vectors, up to ``LISTS``, so that they stay of like sizes.
    """
    keyed = entries.select("label", F.size("v").alias("dim"), "vec_id")
    sizes = {(r["label"], r["dim"]): r["n"] for r in keyed.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    wanted = {key: min(math.ceil(n / LIST), LISTS) for key, n in sizes.items()}
    share = min(1.0, total / max(8 * sum(wanted.values()), 1))
    most = {key: max(least, int(8 * k * share)) for key, k in wanted.items()}
    chosen = sampled(keyed, ["label", "dim"], "vec_id", most, "quantiser").select("vec_id")
    found: dict[tuple[str, int], list] = {}
    for r in entries.join(chosen, "vec_id", "left_semi").select("label", "v").toLocalIterator():
        found.setdefault((r["label"], len(r["v"])), []).append(r["v"])
    out = {}
    for key in sorted(found):
        x = unit(np.array(sorted(found.pop(key)), float))
        out[key] = Quantiser(x, max(1, min(wanted[key], len(x) // 8 or 1)))
        out[key].probes = min(probes or out[key].sufficient(x), len(out[key].coarse))
    return out


def dealt(entries: DataFrame, quantisers: dict) -> DataFrame:
    """``list, query, vec_id, n, v, visits``: each vector once as an entry of its list, and as a query
    in each list that it visits, its own first. Lists are named by label, dimension and centroid."""

    def make():
        names = {key: f"{key[0]}|{key[1]}" for key in quantisers}

        def columns(batch: pa.RecordBatch) -> list:
            labels, ids, ns, vs = (batch.column(c).to_pylist() for c in ("label", "vec_id", "n", "v"))
            out: list[list] = [[], [], [], [], [], []]
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (label, v) in enumerate(zip(labels, vs, strict=True)):
                groups.setdefault((label, len(v)), []).append(i)
            for key, members in groups.items():
                x = unit(np.array([vs[i] for i in members]))
                near = quantisers[key].nearest(x, quantisers[key].probes)
                for i, row, lists in zip(members, x, near.tolist(), strict=True):
                    raw, visits = row.tobytes(), np.array(lists, np.int32).tobytes()
                    for k, c in enumerate([lists[0], *lists]):
                        for column, value in zip(out, (f"{names[key]}|{c}", k > 0, ids[i], ns[i], raw, visits), strict=True):
                            column.append(value)
            return out

        return columns

    return map_arrow(entries.select("label", "vec_id", "n", "v"), make, "list string, query boolean, vec_id long, n long, v binary, visits binary")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``e, q``: a large list is met in blocks of entries and of queries, each pair
    of blocks a group of its own. Entries go to every block of queries and queries to every block
    of entries, so that each query meets each entry once."""
    sizes = rows.groupBy(F.col("list").alias("l")).agg(F.count_if(~F.col("query")).alias("ne"), F.count_if("query").alias("nq"))
    joined = rows.join(stored(sizes, "list-sizes"), F.col("list") == F.col("l"))
    blocks_e = F.greatest(F.ceil(F.col("ne") / BLOCK), F.lit(1)).cast("int")
    blocks_q = F.greatest(F.ceil(F.col("nq") / (4 * BLOCK)), F.lit(1)).cast("int")
    own = F.xxhash64("vec_id")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    e = F.when(F.col("query"), every(blocks_e)).otherwise(F.array(F.pmod(own, blocks_e).cast("int")))
    q = F.when(F.col("query"), F.array(F.pmod(own, blocks_q).cast("int"))).otherwise(every(blocks_q))
    return joined.withColumn("e", F.explode(e)).withColumn("q", F.explode(q)).select("list", "e", "q", "query", "vec_id", "n", "v", "visits")


def match_lists(quantisers: dict, threshold: float):
    """The function for the rows of one list, or of a block of it: ``a, b`` (a forest of links) and ``a, links``."""

    def run(table: pa.Table) -> pa.Table:
        label, dim, which = table.column("list")[0].as_py().rsplit("|", 2)
        quantiser = quantisers[label, int(dim)]
        is_query = np.array(table.column("query").to_pylist(), bool)
        ids = np.array(table.column("vec_id").to_pylist(), np.int64)
        ns = np.array(table.column("n").to_pylist(), np.int64)
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), float).reshape(len(ids), -1)
        visits = np.frombuffer(b"".join(table.column("visits").to_pylist()), np.int32).reshape(len(ids), -1)
        own, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        a, b, counts = [], [], np.zeros(len(ids), np.int64)
        if len(own):
            order = own[np.argsort(ids[own])]
            codes, left = quantiser.encode(x[order], int(which))
            to_center = x[queries] @ quantiser.coarse[int(which)]
            for q0 in range(0, len(queries), BLOCK // 8):
                block = queries[q0 : q0 + BLOCK // 8]
                tables = quantiser.tables(x[block])
                for e0 in range(0, len(order), BLOCK):
                    part = slice(e0, e0 + BLOCK)
                    rough = np.broadcast_to(to_center[q0 : q0 + len(block), None], (len(block), len(order[part]))).copy()
                    for k, t in enumerate(tables):
                        rough += t[:, codes[part, k]]
                    i, j = np.nonzero(rough + left[part] >= threshold - 1e-9)
                    cosine = np.einsum("ij,ij->i", x[block[i]], x[order[part][j]])
                    linked = (cosine >= threshold) & (ids[block[i]] != ids[order[part][j]])
                    i, j = i[linked], j[linked]
                    asks, has = block[i], order[part][j]
                    np.add.at(counts, asks, ns[has])
                    unmet = (visits[has] != visits[asks, :1]).all(1)  # the entry doesn't visit the query's list
                    np.add.at(counts, has[unmet], ns[asks[unmet]])
                    forest = spanning(ids[asks], ids[has])
                    a.append(forest[0])
                    b.append(forest[1])
        links = np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)
        links = spanning(*links)
        n, some = len(links[0]), np.flatnonzero(counts)
        return pa.table({
            "a": np.concatenate([links[0], ids[some]]),
            "b": pa.array(np.concatenate([links[1], ids[some]]), mask=np.r_[np.zeros(n, bool), np.ones(len(some), bool)]),
            "links": pa.array(np.concatenate([np.zeros(n, np.int64), counts[some]])),
        })

    return run


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same vectors as ``a, b`` do, each vector to its component's smallest."""
    if not len(a):
        return a.astype(np.int64), b.astype(np.int64)
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, root[x], root[y])
        np.minimum.at(new, root[y], root[x])
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[root]
        if (new == root).all():
            break
        root = new
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[low]], nodes[low]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, probes: int | None = None, sample: int = 4096, all_samples: int = 250_000
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    typed = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    good = stored(usable(vectors, id_col, vector_col, label_col).withColumn("same", F.sha2(F.concat(F.col("label"), F.lit("|"), F.col("v").cast("string")), 256)), "vectors")
    entries = stored(good.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "vector-entries")
    quantisers = fit(entries, sample, all_samples, probes)
    lists = in_blocks(dealt(entries, quantisers)).groupBy("list", "e", "q")
    found = stored(lists.applyInArrow(match_lists(quantisers, threshold), "a long, b long, links long"), "vector-links")
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "entry")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("entry")).agg(F.sum("links").alias("links"))
    judged = entries.select(F.col("vec_id").alias("entry"), "same", "n").join(counts, "entry", "left").join(roots, "entry", "left")
    judged = stored(judged.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "entry").alias("component_id")), "vector-judged")
    per_row = good.select("vec_id", "same").join(judged, "same").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    for done in (entries, found):
        discard(done)
    out = typed.join(per_row, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
