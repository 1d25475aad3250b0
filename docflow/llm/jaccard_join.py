"""N-gram Jaccard join by partitioning the universe of shingles.

A document's set holds the hashes (64 bits) of its distinct 5-word shingles. Sets are put into
bands of sizes, so that a set links only within its band or the next lower one. In a band at most
H shingles tell two linked sets apart. The universe is hashed into segments; each set indexes its
subset in each segment. A segment of the first type counts one unit (unless the subsets differ),
one of the second type also indexes the subset's one-deletion neighbourhood and counts two (unless
the subsets differ twice). With more units than H, two linked sets have a subset in common. How
many segments of either type a band has is chosen by cost: subsets to index against expected
chance matches, from the number of sets in the band and the mean number of sets that share a shingle (all
shingles over distinct ones, both counted over all texts).

Empty subsets (of the second type: subsets of one or none) would be shared by most sets and are
not indexed; subsets that many sets have (passages that many documents share) are indexed but not
looked into. That can lose units, so a band has some more, and a set with more such subsets than
that allows for uses them all the same: two linked sets miss each other only if both could do
without, and then they have another subset in common. No link is lost.

Groups of sets with a subset in common give candidates in two rounds, each verified exactly: first
each member against the most central one, which makes one component of a group of near copies in a
linear number of pairs; then, in groups whose members still lie in different components, members
of different components against each other. Sketches of their shingles rule most pairs out for
certain before whole sets are compared. Groups with very many members in other components are split by further subsets under
another hash of the universe before that, in at most ``levels`` rounds.

Equal sets are one set from the start, whatever their number.

Edge cases: texts without words have empty sets and link with nothing; texts of fewer than five
words have one shingle, the whole sequence; repeated ids keep a row each; an empty table gives an
empty one; further columns are ignored. Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, map_arrow, perhaps_in, release, small_batches, stored, without_ids
from .components import components
from .wording import CHUNK, LOWER, chunks, mixed, word_hashes, word_places

SHINGLE = 5
#: The threshold 80 %: 100 * intersection >= 80 * union.
PERCENT = 80
#: Entries of a bucket, shingles whose subsets a task holds before it sends, and members from which on a subset
#: counts as frequent.
BUCKET = 1_000_000
HELD = 250_000
SMALL_GROUP = 12
#: Members of a block of a group, and groups of a hub that are met together.
TILE, TOGETHER = 512, 6
#: Share of the units that may lie in subsets that more than SMALL_GROUP sets have.
FREQUENT = 0.12
#: Registers of the count of distinct shingles: it is off by some six in a hundred, and only costs depend on it.
REGISTERS = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def batch_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, end, tokens, sizes`` for runs of texts: each text's sorted distinct shingle hashes, one after another."""
    for first, end, data, offsets in chunks(column, CHUNK):
        data = LOWER[data]
        starts, ends, counts = word_places(data, offsets)
        h = word_hashes(data, starts, ends)
        begin = np.cumsum(counts) - counts
        made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))  # few words are one shingle
        at = np.cumsum(made) - made
        tokens = np.zeros(int(made.sum()), np.uint64)
        for size in range(1, SHINGLE + 1):
            chosen = np.flatnonzero(counts >= size if size == SHINGLE else counts == size)
            n = made[chosen]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            words, total = np.repeat(begin[chosen], n) + place, np.full(len(place), size, np.uint64)
            for k in range(size):
                total = mixed(total * MIX + h[words + k])
            tokens[np.repeat(at[chosen], n) + place] = total
        for s, e in zip(at.tolist(), (at + made).tolist(), strict=True):
            tokens[s:e].sort()
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        new[at[at < len(tokens)]] = True
        until = np.concatenate([[0], np.cumsum(new)])
        yield first, end, tokens[new], until[at + made] - until[at]


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An id of each set, as a signed 64-bit integer; 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens, 31))])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64), 32), 0).astype(np.uint64).view(np.int64)


# Bands of sizes


@lru_cache(maxsize=1)
def band_ends(most: int = 1 << 40) -> np.ndarray:
    """The largest size of each band: a set links only within its band and the next lower one."""
    ends, low = [], 1
    while low < most:
        ends.append(low * 100 // PERCENT)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(band_ends(), n)


class Spread(NamedTuple):
    """What is known of all sets before they are indexed: how many each band has, and the chance that a shingle of
    one set is in another one."""

    sets: dict[int, int]
    shared: float

    def plan(self, band: int) -> tuple[int, int, int, int]:
        return layout(band, self.sets.get(band, 0) + self.sets.get(band + 1, 0), self.shared)


@lru_cache(maxsize=None)
def layout(band: int, n_sets: int, shared: float) -> tuple[int, int, int, int]:
    """Segments of the first and second type, and how many weak ones of each type are allowed for.

    The cost of a layout is the subsets that a set indexes, plus chance matches per set: pairs of
    sets whose subset in a segment is the same single shingle. With ``shared`` as it was measured, ordinary
    text takes segments of the first type alone; where shingles recur in very many sets, the larger
    segments of the second type cost less.
    """
    high = int(band_ends()[band])
    low = int(band_ends()[band - 1]) + 1 if band else 1
    units = (high + high * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT) + 1
    best = None
    for part in range(5):  # no, a quarter, ... all of the units by segments of the second type
        second = units * part // 8
        first = units - 2 * second
        weak1 = weak2 = 0
        for _ in range(3):  # more segments hold fewer shingles, which makes more of them weak
            k = low / (first + second + weak1 + 2 * weak2)
            z1, z2 = first * math.exp(-k), second * (1 + k) * math.exp(-k)
            weak1 = math.ceil(z1 + 3 * math.sqrt(z1) + FREQUENT * units) if first else 0
            weak2 = math.ceil(z2 + 3 * math.sqrt(z2)) if second else 0
        # each weak one of the first type costs a unit, of the second two units for either set
        made1, made2 = (first + weak1 + 4 * weak2, second) if first or not second else (0, second + 2 * weak2)
        m = made1 + made2
        k = low / m
        cost = made1 + made2 * (k + 1) + n_sets / 2 * (made1 * k * math.exp(-2 * k) + made2 * k * math.exp(-2 * k) / 2) * shared
        if best is None or cost < best[0]:
            best = (cost, made1, made2, weak1, weak2)
    return best[1:]


def signatures(tokens: np.ndarray, owner: np.ndarray, band: np.ndarray, spread: Spread, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of indexed subsets, for each its owner, and for each set how many units of frequent
    subsets it can do without (-1: it needs them all).

    ``tokens`` of several sets one after another, ``owner`` the set of each token (ascending),
    ``band`` for each set that in which it is indexed here.
    """
    n_sets = len(band)
    plans = {b: spread.plan(b) for b in np.unique(band).tolist()}
    made1 = np.array([plans[b][0] for b in band.tolist()], np.int64)
    made2 = np.array([plans[b][1] for b in band.tolist()], np.int64)
    allowed1 = np.array([plans[b][2] for b in band.tolist()])
    allowed2 = np.array([plans[b][3] for b in band.tolist()])
    m = made1 + made2
    base = np.cumsum(m) - m
    spread = mixed(tokens, 2 * salt + 1)
    segment = ((spread >> np.uint64(32)) * m[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    place = base[owner] + segment
    order = np.argsort(place, kind="stable")
    place, g = place[order], mixed(tokens, 2 * salt + 2)[order]
    counts = np.bincount(place, minlength=int(m.sum()))
    sums = np.zeros(int(m.sum()), np.uint64)
    filled = np.flatnonzero(counts)
    if len(place):
        sums[filled] = np.add.reduceat(g, np.cumsum(counts[filled]) - counts[filled])
    holder = np.repeat(np.arange(n_sets), m)
    index = np.arange(len(holder)) - base[holder]
    second = index >= made1[holder]
    weak = np.where(second, counts <= 1, counts == 0)
    n_weak1 = np.bincount(holder, weak & ~second, n_sets)
    n_weak2 = np.bincount(holder, weak & second, n_sets)
    poor = (n_weak1 > allowed1) | (n_weak2 > allowed2)
    use = ~weak | poor[holder]
    tag = mixed((band[holder].astype(np.uint64) << np.uint64(32)) | index.astype(np.uint64), salt + 7)
    keys, owners = [mixed(sums[use] + tag[use])], [holder[use]]
    if second.any():
        drop = second[place] & use[place]
        keys.append(mixed(sums[place[drop]] - g[drop] + tag[place[drop]]))
        owners.append(holder[place[drop]])
    spare = np.where(poor | (made2 > 0), -1, allowed1 - n_weak1).astype(np.int64)
    return np.concatenate(keys), np.concatenate(owners), spare


def both_bands(tokens: np.ndarray, n: np.ndarray, spread: Spread, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sets (``n`` tokens each, one after another) in their own band and, where a link is possible, in
    the next lower one.

    Each set has two roles, 2 i in its own band and 2 i + 1 in the lower one; given are the keys,
    their roles and what each role can spare.
    """
    own = band_of(n)
    lower = (own > 0) & (-(-n * PERCENT // 100) <= band_ends()[np.maximum(own - 1, 0)])
    owner = np.repeat(np.arange(len(n)), n)
    keys, who, spare = signatures(tokens, owner, own, spread, salt)
    role, spares = who * 2, np.full(2 * len(n), -1, np.int64)
    spares[::2] = spare
    if lower.any():
        chosen = np.flatnonzero(lower)
        keep = lower[owner]
        new = np.cumsum(lower) - 1
        k2, w2, spare = signatures(tokens[keep], new[owner[keep]], own[chosen] - 1, spread, salt)
        keys, role = np.concatenate([keys, k2]), np.concatenate([role, chosen[w2] * 2 + 1])
        spares[chosen * 2 + 1] = spare
    return keys, role, spares


# Spark stages


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sid, sketch`` of each row: its set's size, id and sketch; and ``registers`` of all shingles of a batch
    in its first row."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            n, sid, sketches, registers = [], [], [], np.zeros(REGISTERS, np.uint8)
            for _, _, tokens, sizes in batch_sets(batch.column("text")):
                registers = np.maximum(registers, counted(tokens))
                n.append(sizes)
                sid.append(set_ids(tokens, sizes))
                ends = np.cumsum(sizes)
                sketches += (sketch(tokens[e - k : e]) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True))
            joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n, sid)]
            first = [registers.tobytes(), *[None] * (len(batch) - 1)] if len(batch) else []
            return [batch.column("doc_id"), pa.array(joined[0].astype(np.int64)), pa.array(joined[1]), sketches, pa.array(first, pa.binary())]

        return columns

    return map_arrow(docs, make, "doc_id long, n long, sid long, sketch binary, registers binary")


def counted(tokens: np.ndarray) -> np.ndarray:
    """HyperLogLog registers: of the tokens of each register the longest run of leading zeros of another part of the hash, and one."""
    h = mixed(tokens, 53)
    zeros = 53 - np.frexp((h >> np.uint64(11)).astype(float))[1]  # of 53 bits
    out = np.zeros(REGISTERS, np.uint8)
    np.maximum.at(out, (h & np.uint64(REGISTERS - 1)).astype(np.int64), (zeros + 1).astype(np.uint8))
    return out


def distinct_tokens(members: DataFrame) -> float:
    """How many distinct shingles all texts have, about."""
    byte = F.conv(F.hex(F.substring("registers", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
    rows = members.filter("registers IS NOT NULL").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))))
    most = rows.groupBy("i").agg(F.max(byte).alias("m")).collect()  # a row for each register
    m = [r["m"] for r in most] + [0] * (REGISTERS - len(most))
    estimate = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / sum(2.0**-x for x in m)
    return REGISTERS * math.log(REGISTERS / m.count(0)) if estimate < 2.5 * REGISTERS and m.count(0) else estimate


def entries(docs: DataFrame, spread: Spread, buckets: int) -> DataFrame:
    """``bucket, flush, keys, roles``: indexed subsets as binary arrays of 32-bit keys (unique but for chance within a
    bucket, and what chance brings together is told apart later) and of roles, numbered within a flush. Of a key that many sets of a flush
    have, the bucket only gets notice, so that no key fills it, however many sets have it. Rows with a negative bucket
    have what isn't dealt by key: what a flush's roles are (set ids and spare units), and which of them have its frequent keys.

    ``docs`` has each set once.
    """

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            tokens, sizes, owned = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, role, spares = both_bands(tokens, sizes, spread)
            order = np.argsort(keys)
            keys, role = keys[order], role[order].astype(np.uint16 if len(owned) < 1 << 15 else np.uint32)
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
            times = np.diff(np.r_[starts, len(keys)])
            often = np.repeat(times > SMALL_GROUP, times)
            hot = (keys[often].astype(np.uint32), role[often], bucket_of(keys[often], buckets))
            told = starts[times > SMALL_GROUP]  # of a frequent key the bucket gets one entry, which is no role's
            keys, role = np.concatenate([keys[~often], keys[told]]), np.concatenate([role[~often], np.full(len(told), np.iinfo(role.dtype).max, role.dtype)])
            bucket = bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            keys, role, bucket = keys[order].astype(np.uint32), role[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, int)
            pieces = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False))
            name = int(mixed(np.array([mixed(owned.view(np.uint64), 41).sum() + np.uint64(len(owned))]), 43).view(np.int64)[0])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(bucket[cuts], [-1 - name % buckets] * 2).astype(np.int32)),
                    pa.array(np.full(len(pieces) + 2, name)),
                    pa.array([*(keys[s:e].tobytes() for s, e in pieces), owned.tobytes(), (hot[0].astype(np.int64) | hot[2].astype(np.int64) << 32).tobytes()], pa.binary()),
                    pa.array([*(role[s:e].tobytes() for s, e in pieces), spares.tobytes(), hot[1].astype(np.uint32).tobytes()], pa.binary()),
                ],
                names=["bucket", "flush", "keys", "roles"],
            )

        n = 0
        for batch in batches:
            for _, _, tokens, sizes in batch_sets(batch.column("text")):
                some = sizes > 0
                held.append((tokens, sizes[some], set_ids(tokens, sizes)[some]))
                n += len(tokens) + 8 * len(sizes)
                if n > HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        release()

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "bucket int, flush long, keys binary, roles binary")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


GROUPS_DDL = "gid long, flush long, role int, size long, frequent long, sid long, spare long"


def groups_of(table: pa.Table) -> pa.Table:
    """Members of keys that two roles or more have in a bucket, one row each with the group's size.

    Of keys with the same members one stays. Rows without a gid tell how many keys of large groups
    a role has here (``frequent``), or a role's set and spare units (``sid``).
    """
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return pa.concat_tables([apart(*row) for row in zip(*(table.column(c).to_pylist() for c in ("flush", "keys", "roles")), strict=True)])
    flushes = table.column("flush").to_numpy()
    keys, role, flush, notice = opened(table)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(keys) else order
    keys, role, flush, notice = keys[order], role[order], flush[order], notice[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)]).astype(np.int64)
    chosen = np.zeros(len(starts), bool)
    if len(starts):
        # a set has a key in either of its roles, so that equal members are equal sums over the sets
        marks = np.add.reduceat(mixed(flushes[flush].view(np.uint64) + (role >> 1).astype(np.uint64), 3), starts)
        chosen[np.unique(marks, return_index=True)[1]] = True
        told = np.logical_or.reduceat(notice, starts)  # a key that is frequent in some flush is so for all
        chosen |= told
        sizes = np.where(told, np.maximum(sizes, SMALL_GROUP + 1), sizes)
    counts = np.diff(np.r_[starts, len(keys)])
    keep, size = np.repeat(chosen, counts) & ~notice, np.repeat(sizes, counts)
    often = np.flatnonzero((size > SMALL_GROUP) & ~notice)
    names, times = np.unique(flush[often].astype(np.int64) << 32 | role[often], return_counts=True)
    members = group_rows(gid=keys[keep].astype(np.int64) | bucket << 32, flush=flushes[flush[keep]], role=role[keep], size=size[keep])
    return pa.concat_tables([members, group_rows(flush=flushes[names >> 32], role=names & 0xFFFFFFFF, frequent=times)])


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket with their roles, the places of their flushes in the table, and whether they are only notices."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, (keys, roles) in enumerate(zip(table.column("keys").to_pylist(), table.column("roles").to_pylist(), strict=True)):
        key = np.frombuffer(keys, np.uint32)
        role = np.frombuffer(roles, np.uint16 if 2 * len(roles) == len(keys) else np.uint32)
        for column, x in zip(out, (key, role.astype(np.uint32), np.full(len(key), i, np.int32), role == np.iinfo(role.dtype).max), strict=True):
            column.append(x)
    return tuple(map(np.concatenate, out))


def apart(flush: int, keys: bytes, roles: bytes) -> pa.Table:
    """Rows of what a flush sends besides its keys: its roles, or members of its frequent keys."""
    ids, other = np.frombuffer(keys, np.int64), np.frombuffer(roles, np.int64 if len(roles) == 2 * len(keys) and len(keys) else np.uint32)
    if len(roles) == 2 * len(keys):
        role = np.arange(len(other))
        return group_rows(flush=np.full(len(role), flush), role=role, sid=np.repeat(ids, 2), spare=other)
    names, times = np.unique(other, return_counts=True)
    members = group_rows(gid=ids, flush=np.full(len(ids), flush), role=other, size=np.full(len(ids), SMALL_GROUP + 1))
    return pa.concat_tables([members, group_rows(flush=np.full(len(names), flush), role=names, frequent=times)])


def group_rows(**columns: np.ndarray) -> pa.Table:
    n = len(columns["flush"])
    kinds = {name: {"long": pa.int64(), "int": pa.int32()}[kind] for name, kind in (c.split() for c in GROUPS_DDL.split(", "))}
    return pa.table({name: pa.array(columns[name].astype(kind.to_pandas_dtype())) if name in columns else pa.nulls(n, kind) for name, kind in kinds.items()})


def needed(rows: DataFrame) -> DataFrame:
    """``gid, sid, size`` of the groups to look into.

    A set that has few enough keys of large groups, by what it can spare, meets each of its links
    in another group as well: large groups keep only the sets that have more.
    """
    by = ["flush", "role"]
    counts = rows.filter("frequent IS NOT NULL").groupBy(*by).agg(F.sum("frequent").alias("k"))
    roles = rows.filter("sid IS NOT NULL").select(*by, "sid", "spare").join(counts, by, "left")
    roles = roles.select(*by, "sid", (F.coalesce("k", F.lit(0)) > F.col("spare")).alias("heavy"))
    members = rows.filter("gid IS NOT NULL").select("gid", *by, "size").join(roles, by)
    members = stored(members.filter((F.col("size") <= SMALL_GROUP) | F.col("heavy")).select("gid", "sid", "size"), "jaccard-needed")
    large = members.filter(F.col("size") > SMALL_GROUP).select("gid", "sid")
    sizes = stored(large.groupBy("gid").agg(F.count("*").alias("size")), "jaccard-sizes")  # of those that need the group
    return members.filter(F.col("size") <= SMALL_GROUP).union(large.join(sizes, "gid").select("gid", "sid", "size"))


def with_hubs(members: DataFrame) -> DataFrame:
    """``gid, hub, sid`` of groups of two or more, from ``gid, sid, size``. The hub is the member that meets most others over
    all its groups: among near copies the one from which the others are made, or the nearest to it.

    Hubs are found by aggregates, which are written before they are joined back: so the engine can split a join at a large
    group, and no group has to be in one task.
    """
    weight = members.groupBy("sid").agg(F.sum("size").alias("w"))
    weighed = stored(members.select("gid", "sid").join(weight, "sid"), "jaccard-weighed")
    hubs = weighed.groupBy("gid").agg(F.max(F.struct("w", "sid")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    hubs = stored(hubs.select("gid", F.col("h.sid").alias("hub")), "jaccard-hubs")
    return weighed.select("gid", "sid").join(hubs, "gid").select("gid", "hub", "sid")


def find_groups(docs: DataFrame, spread: Spread, total: int) -> DataFrame:
    buckets = max(16, math.ceil(total / 2 / BUCKET))
    found = entries(docs, spread, buckets)
    keys = stored(found.groupBy("bucket").applyInArrow(groups_of, GROUPS_DDL), "jaccard-keys")
    grouped = stored(needed(keys), "jaccard-grouped")
    discard(keys)
    groups = stored(with_hubs(grouped), "jaccard-groups")
    discard(grouped)
    return groups


def sketch(found: np.ndarray) -> bytes:
    """Parities of a set's shingles in as many bits as a power of two, one for each shingle or more.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    size = max(64, 1 << int(max(len(found), 1) - 1).bit_length())
    at = (mixed(found, 97) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(raw: bytes, words: int) -> np.ndarray:
    """A sketch cut down to so many 64-bit words, parities put together."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)


def set_table(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sid, hashes`` of the sets of ``chosen`` (``sid, doc``: an id of a document that has it)."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            parts = list(batch_sets(batch.column("text")))
            sizes = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
            values = np.concatenate([p[2] for p in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return [batch.column("sid"), pa.ListArray.from_arrays(offsets, values)]

        return columns

    some = docs.filter(perhaps_in(F.col("doc_id"), chosen.select("doc")))
    return map_arrow(some.join(chosen, F.col("doc_id") == F.col("doc")).select("sid", "text"), make, "sid long, hashes array<long>").dropDuplicates(["sid"])


def plausible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that may link by exact bounds: sizes, and sketches that differ in no more bits than
    linked sets differ in shingles. Only these get their whole sets compared. ``known`` has ``sid, n, sketch``."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            x, y, nx, ny = (batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny"))
            keep = [
                100 * min(n, m) >= PERCENT * max(n, m) and differing(p, q) <= (n + m) * (100 - PERCENT) // (100 + PERCENT) for p, q, n, m in zip(x, y, nx, ny, strict=True)
            ]
            return [batch.column("a"), batch.column("b"), keep]

        return columns

    left = known.select(F.col("sid").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    right = known.select(F.col("sid").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "nx", "ny")
    return map_arrow(joined, make, "a long, b long, keep boolean").filter("keep").select("a", "b")


def differing(x: bytes, y: bytes) -> int:
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def linked(pairs: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among pairs ``a, b``, which are ruled out by sketches first; the rest have their whole sets made from
    their texts and intersected exactly. Row by row in the engine, so that memory holds two sets at a time however
    long they are."""
    pairs = stored(plausible(pairs, known), "jaccard-pairs")
    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    sets = stored(set_table(docs, known.join(wanted, F.col("sid") == F.col("s")).select("sid", "doc")), "jaccard-hashes", parts=1 + n // 2000)
    left = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("x", "y")))
    links = stored(joined.filter(100 * F.col("both") >= PERCENT * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"), "jaccard-links", parts=1 + n // 2000)
    discard(sets)
    discard(pairs)
    return links


def stars(groups: DataFrame) -> DataFrame:
    """Pairs of the members of groups and their hubs."""
    return groups.filter("hub <> sid").select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct()


def labelled(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``gid, hub, sid, root, size, far`` of those groups whose members lie in different components: how many members
    there are, and how many of them lie in other components than the hub."""
    members = groups.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    members = stored(members.select("gid", "hub", "sid", F.coalesce("root", "sid").alias("root")), "jaccard-members")
    own = F.max(F.when(F.col("sid") == F.col("hub"), F.col("root")))
    mixed_ones = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), own.alias("own"), F.count("*").alias("size")).filter("lo < hi")
    open_ones = stored(members.join(stored(mixed_ones.select("gid", "own", "size"), "jaccard-sizes"), "gid"), "jaccard-open")
    discard(members)
    far = stored(open_ones.groupBy("gid").agg(F.count_if(F.col("root") != F.col("own")).alias("far")), "jaccard-far")
    mixed_members = stored(open_ones.join(far, "gid").select("gid", "hub", "sid", "root", "size", "far"), "jaccard-mixed")
    discard(open_ones)
    return mixed_members


def possible(table: pa.Table) -> pa.Table:
    """Pairs of members of a tile's groups that lie in different components and may link, by their sketches, each once. Of a tile
    of two blocks, pairs with a member of either. Where a tile's groups have mostly the same members, these are
    met once for all groups."""
    tile, gid, sid, root, n, block = (table.column(c).to_numpy().astype(np.int64) for c in ("tile", "gid", "sid", "root", "n", "block"))
    sketches = table.column("sketch").to_pylist()
    order = np.lexsort((sid, gid, tile))
    found: list[np.ndarray] = []
    for own in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        two = block[own].min() != block[own].max()
        groups = np.split(own, np.flatnonzero(np.diff(gid[own])) + 1)
        whole = own[np.unique(sid[own], return_index=True)[1]]
        if len(whole) ** 2 <= sum(len(g) ** 2 for g in groups):
            groups = [whole]
        made = [near_pairs(sid[g], root[g], n[g], block[g] if two else None, [sketches[i] for i in g.tolist()]) for g in groups if len(g) > 1]
        if made:
            found.append(np.unique(np.concatenate(made), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def near_pairs(sid: np.ndarray, root: np.ndarray, n: np.ndarray, block: np.ndarray | None, sketches: list[bytes]) -> np.ndarray:
    """The pairs, smaller id first, that lie in different components (and blocks) and may link."""
    words = min(map(len, sketches)) // 8
    bits = np.stack([folded(x, words) for x in sketches])
    out = []
    for i in range(len(sid) - 1):
        apart = root[i + 1 :] != root[i]
        at = np.flatnonzero(apart if block is None else apart & (block[i + 1 :] != block[i])) + i + 1
        at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= (n[at] + n[i]) * (100 - PERCENT) // (100 + PERCENT)]
        out.append(np.stack([np.minimum(sid[at], sid[i]), np.maximum(sid[at], sid[i])], 1))
    return np.concatenate(out)


def cross_pairs(members: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of members of a group in different components that may link, from ``gid, hub, sid, root, size``.

    The groups of a hub, which share most of their members, are met together, some ``TOGETHER`` of them in tiles of two blocks of
    members, ``TILE`` to a block; tiles are put into buckets.
    """
    most = stored(members.groupBy("hub").agg(F.ceil(F.max("size") / TILE).cast("int").alias("k"), F.ceil(F.count("*") / F.max("size") / TOGETHER).alias("parts")), "jaccard-hubs")
    rows = members.join(most, "hub").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    part = F.pmod(F.xxhash64("gid", F.lit(6)), F.col("parts"))
    rows = rows.select(F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other"), part).alias("tile"), "gid", "sid", "root", "block")
    buckets = max(16, math.ceil(rows.count() / 4000))
    rows = rows.join(known.select("sid", "n", "sketch"), "sid")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("tile"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(possible, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 3, small_group: int = 4096, shared: float | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest id reachable by links.

    ``shared`` is the chance that a shingle of one set is in another one; it is measured where it isn't given.
    """
    texts = id_text(docs, id_col, text_col)
    members = stored(described(texts), "jaccard-sets")
    known = stored(members.filter("n > 0").groupBy("sid").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")), "jaccard-known")
    # Counted by size class, of which there are as many as the logarithm of the longest text has.
    ends = band_ends().tolist()
    exact = known.groupBy(F.floor(F.log2("n") * 8).alias("class")).agg(F.count("*").alias("k"), F.min("n").alias("n"), F.sum("n").alias("total")).collect()
    bands: dict[int, int] = {}
    for r in exact:
        b = int(np.searchsorted(ends, r["n"]))
        bands[b] = bands.get(b, 0) + r["k"]
    total, n_sets = sum(r["total"] for r in exact), sum(r["k"] for r in exact)
    if shared is None:  # a shingle is in total / distinct sets on average
        shared = max(total / max(distinct_tokens(members), 1) - 1, 0) / max(n_sets, 1)
    spread = Spread(bands, float(f"{shared:.2g}"))
    # Each set is indexed from one document; the other documents that have it are left out.
    own = members.filter("doc_id IS NOT NULL AND n > 0").join(known.select(F.col("sid").alias("s"), "doc"), F.col("sid") == F.col("s"))
    copies = stored(own.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("doc")).alias("first")).filter("NOT first").select("doc_id"), "jaccard-copies")
    groups = find_groups(without_ids(texts, "doc_id", copies), spread, total)
    links = linked(stars(groups), known, texts)
    for level in range(1, levels + 1):
        roots = components(links)
        open_groups = labelled(groups, roots)
        discard(groups)
        last = level == levels
        small = open_groups if last else open_groups.filter(F.col("far") <= small_group)
        links = links.union(linked(cross_pairs(small, known), known, texts))
        large = open_groups.filter(F.col("far") > small_group)
        if last or large.isEmpty():
            break
        groups = stored(refined(large, known, texts, spread, level), "jaccard-finer")
        links = links.union(linked(stars(groups), known, texts))
    roots = components(links).select(F.col("node").alias("sid"), "root")
    # The component's smallest document, over the distinct sets; then back to every document.
    rooted = known.join(roots, "sid", "left").select("sid", "doc", F.coalesce("root", "sid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stored(rooted.join(least, "root").select(F.col("sid").alias("s"), "component_id"), "jaccard-named")
    out = members.join(named, (F.col("sid") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def refined(large: DataFrame, known: DataFrame, docs: DataFrame, spread: Spread, level: int) -> DataFrame:
    """Large groups split by subsets under another hash: ``gid, hub, sid`` of the parts."""

    def make():
        def columns(batch: pa.RecordBatch) -> list:
            found = batch.column("hashes")
            sizes = found.value_lengths().to_numpy().astype(np.int64)
            if not len(sizes):
                return [[], [], []]
            keys, role, _ = both_bands(found.flatten().to_numpy().view(np.uint64), sizes, spread, level)
            who = pa.array(role >> 1)
            return [batch.column("gid").take(who), keys.view(np.int64), batch.column("sid").take(who)]

        return columns

    wanted = known.join(large.select(F.col("sid").alias("s")).distinct(), F.col("sid") == F.col("s")).select("sid", "doc")
    parts = map_arrow(large.select("gid", "sid").join(set_table(docs, wanted), "sid").select("gid", "sid", "hashes"), make, "gid long, key long, sid long")
    parts = parts.select(F.xxhash64("gid", "key").alias("gid"), "sid").distinct()
    sizes = parts.groupBy("gid").agg(F.count("*").alias("size")).filter("size > 1")
    return with_hubs(stored(parts.join(sizes, "gid"), "jaccard-grouped"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; columns unchanged. Rows without an id stay:
    nothing can be said of them. Rows that share an id stay if any of them is the smallest."""
    found = jaccard_components(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    judged = found.groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("component_id")).alias("goes"))
    return without_ids(docs, id_col, stored(judged.filter("goes").select("doc_id"), "jaccard-others"))
