"""Event logs of documents: patches between block lists, readers' state, delivery."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lists import edit_steps
from .block_list import BlockList, Reset

TERMINAL = ("COMPLETED", "FAILED")


def splice(old: list[dict], new: list[dict]) -> tuple[int, int, int]:
    """Length of the common start, and where the common end begins in the old and new list."""
    same = 0
    shorter = min(len(old), len(new))
    while same < shorter and old[same] == new[same]:
        same += 1
    tail = 0
    while tail < shorter - same and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    return same, len(old) - tail, len(new) - tail


def patches(old: list[dict], new: list[dict], revision: int) -> list[dict]:
    """Patches from one list to another: one for each new block if none goes, else one in all."""
    start, end_old, end_new = splice(old, new)
    removed = [b["blockId"] for b in old[start:end_old]]
    added = new[start:end_new]
    steps = [added] if removed else [[b] for b in added]
    anchors = [old[start - 1]["blockId"] if start else None, *(s[-1]["blockId"] for s in steps if s)]
    return [
        {"baseRevision": revision + i, "revision": revision + i + 1, "afterBlockId": anchors[i], "removeBlockIds": removed if i == 0 else [], "blocks": step}
        for i, step in enumerate(steps)
    ]


def patch_onto(blocks: BlockList, revision: int, patch: dict) -> int:
    """The revision after a patch, which changes ``blocks``; :class:`Reset` where it doesn't fit, and nothing has changed."""
    if (patch["baseRevision"], patch["revision"]) != (revision, revision + 1):
        raise Reset("revision")
    blocks.patch(patch.get("afterBlockId"), patch["removeBlockIds"], patch["blocks"])
    return revision + 1


def apply_patch(blocks: list[dict], revision: int, patch: dict) -> tuple[list[dict], int]:
    """A list and its revision after a patch."""
    made = BlockList(blocks)
    revision = patch_onto(made, revision, patch)
    return list(made), revision


class Preview(NamedTuple):
    """A reader's state of one document. The next state takes over its blocks."""

    blocks: BlockList = BlockList()
    revision: int = 0
    cursor: int | None = None
    status: str = "OCR"
    ocr: int = 0
    images: int = 0
    total: int = 0
    reset: bool = False

    def plain(self) -> list:
        """The state as JSON has it."""
        return [list(self.blocks), *self[1:]]

    @classmethod
    def restored(cls, plain: list) -> Preview:
        return cls(BlockList(plain[0]), *plain[1:])


def progress_of(data: dict) -> tuple[str, int, int, int]:
    """Status and counts of a progress event: all images, those read, those done."""
    total, ocr, images = data["totalImages"], data["completedOcrImages"], data["completedImages"]
    if data["status"] in TERMINAL or not (0 <= ocr <= total and 0 <= images <= total):
        raise Reset("progress")
    return data["status"], total, ocr, images


def reduce_event(state: Preview, seq: int, kind: str, data: dict) -> Preview:
    """The state after an event: repeats are ignored, gaps ask for a reset, an end stays."""
    if state.status in TERMINAL:
        return state
    if kind == "document.snapshot":
        if state.cursor is not None and seq < state.cursor:
            return state
        return Preview(BlockList(data["blocks"]), data["revision"], seq, data["status"], *(data.get(k, 0) for k in ("completedOcrImages", "completedImages", "totalImages")))
    if state.cursor is not None and seq <= state.cursor:
        return state
    if state.cursor is None or seq != state.cursor + 1:
        return state._replace(reset=True)
    try:
        match kind:
            case "blocks.patch":
                state = state._replace(revision=patch_onto(state.blocks, state.revision, data))
            case "document.progress":
                status, total, ocr, images = progress_of(data)
                state = state._replace(status=status, total=total, ocr=ocr, images=images)
            case "document.completed" | "document.failed":
                state = state._replace(status=kind.rpartition(".")[2].upper())
            case _:
                raise Reset("kind")
    except (Reset, KeyError):
        return state._replace(reset=True)
    return state._replace(cursor=seq)


STATE_DDL = "document_id string, blocks string, revision long, cursor long, status string, completed_ocr int, completed int, total int, reset boolean"


def as_row(document_id: str, s: Preview) -> tuple:
    return (document_id, json.dumps(list(s.blocks), ensure_ascii=False, sort_keys=True), s.revision, s.cursor, s.status, s.ocr, s.images, s.total, s.reset)


def with_sequence(events: DataFrame, order: list[str], after: DataFrame | None = None) -> DataFrame:
    """A dense sequence for each document, on from ``after`` (``document_id, seq``) if given."""
    seq = F.row_number().over(W.partitionBy("document_id").orderBy(*order)).cast("long")
    numbered = events.withColumn("seq", seq)
    if after is None:
        return numbered
    last = after.groupBy("document_id").agg(F.max("seq").alias("last of before"))
    return numbered.join(last, "document_id", "left").withColumn("seq", F.col("seq") + F.coalesce("last of before", F.lit(0))).drop("last of before")


def events_after(events: DataFrame, cursors: DataFrame, limit: int = 32) -> DataFrame:
    """The next page of events (``document_id, seq``) after the cursor of each reader (``document_id, cursor``)."""
    after = events.join(cursors, "document_id").filter(F.col("seq") > F.col("cursor"))
    place = F.row_number().over(W.partitionBy("document_id").orderBy("seq"))
    return after.withColumn("place of the page", place).filter(F.col("place of the page") <= limit).drop("place of the page")


def consume(deliveries: DataFrame, receipts: DataFrame, terminal: DataFrame) -> DataFrame:
    """Deliveries without a receipt, once each; those to an ended document are marked as errors."""
    fresh = deliveries.dropDuplicates(["document_id", "source_id"]).join(receipts.select("document_id", "source_id"), ["document_id", "source_id"], "left_anti")
    ended = terminal.select("document_id").distinct().withColumn("late", F.lit(True))
    return fresh.join(ended, "document_id", "left").withColumn("late", F.coalesce("late", F.lit(False)))


def reconciled(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """What has to be done to rows by key, so that the old ones become the new ones: insert, update, delete or keep."""
    was = old.select(*key, F.col(value).alias("value before"), F.lit(True).alias("there before"))
    now = new.select(*key, F.col(value).alias("value after"), F.lit(True).alias("there after"))
    both = was.join(now, key, "full")
    same = F.col("value before").eqNullSafe(F.col("value after"))
    step = F.when(F.col("there before").isNull(), "insert").when(F.col("there after").isNull(), "delete").when(same, "keep").otherwise("update")
    return both.select(*key, step.alias("step"), F.col("value after").alias(value))


def list_steps(lists: DataFrame) -> DataFrame:
    """``document_id, number, step, id, after`` of ``lists`` (``document_id, old, new``: arrays of distinct ids): the fewest steps from one to the other, in order."""

    @F.pandas_udf("array<struct<step: string, id: string, after: string>>")
    def steps(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("step", "id", "after"), s, strict=True)) for s in edit_steps(list(o), list(n))] for o, n in zip(old, new, strict=True)])

    return lists.select("document_id", F.posexplode(steps("old", "new")).alias("number", "s")).select("document_id", "number", "s.*")


def work_batches(arrivals: DataFrame, idle: str) -> DataFrame:
    """Arrivals (``worker, ts``) put together until nothing has come for ``idle``: ``worker, first, last, n``."""
    grouped = arrivals.groupBy("worker", F.session_window("ts", idle)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return grouped.select("worker", "first", "last", "n")


def heartbeats(signs: DataFrame, every: int) -> DataFrame:
    """The last sign of each worker (``worker, ts``) and how many intervals of so many seconds had one."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / every)
    return signs.groupBy("worker").agg(F.max("ts").alias("ts"), F.count_distinct(slot).alias("beats"))


def outbox(payloads: DataFrame, sent: DataFrame) -> DataFrame:
    """Those of ``payloads`` (``document_id, kind, seq, payload``) that say something new, with their signature: others equal
    the one before, or the last one of ``sent`` (``document_id, kind, signature``). Written again after a crash they are
    the same rows."""
    by = ["document_id", "kind"]
    last = sent.select(*by, F.col("signature").alias("last signature"))
    rows = payloads.withColumn("signature", F.sha2("payload", 256)).join(last, by, "left")
    before = F.coalesce(F.lag("signature").over(W.partitionBy(*by).orderBy("seq")), F.col("last signature"))
    return rows.withColumn("before it", before).filter(~F.col("signature").eqNullSafe(F.col("before it"))).drop("before it", "last signature")


def ended(transitions: DataFrame) -> DataFrame:
    """What each of ``transitions`` to an end (``document_id, seq, kind`` complete or fail, ``result``) does: the first one counts;
    the same completion again is fine, another one an error, and a failure after the end nothing."""
    one = W.partitionBy("document_id").orderBy("seq")
    first, kind, result = F.row_number().over(one) == 1, F.first("kind").over(one), F.first("result").over(one)
    again = (kind == "complete") & (F.col("kind") == "complete") & F.col("result").eqNullSafe(result)
    return transitions.withColumn("outcome", F.when(first, "applied").when(F.col("kind") == "fail", "ignored").when(again, "same").otherwise("error"))


def resumption(cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """What a reader at a cursor gets: a fresh start where the log doesn't reach (``gone``), nothing more (``end``), or what
    follows (``events``). ``heads``: document_id, last, terminal."""
    rows = cursors.join(heads, "document_id", "left")
    gone = F.col("last").isNull() | (F.col("cursor") < 0) | (F.col("cursor") > F.col("last"))
    return rows.withColumn("answer", F.when(gone, "gone").when((F.col("cursor") == F.col("last")) & F.col("terminal"), "end").otherwise("events"))


def block_versions(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Versions after a new list: 1 for new blocks, one more if the XML changed or the block was out.

    ``wanted``: document_id, block_id, xml. ``known`` has version and active too. Blocks that are
    no longer wanted stay with ``active`` false.
    """
    old = known.select("document_id", "block_id", F.col("xml").alias("old_xml"), "version", "active")
    both = wanted.join(old, ["document_id", "block_id"], "full")
    changed = ~F.col("xml").eqNullSafe(F.col("old_xml")) | ~F.coalesce("active", F.lit(False))
    version = F.when(F.col("xml").isNull(), F.col("version")).when(F.col("version").isNull(), 1).otherwise(F.col("version") + changed.cast("int"))
    return both.select("document_id", "block_id", version.cast("long").alias("version"), F.coalesce("xml", "old_xml").alias("xml"), F.col("xml").isNotNull().alias("active"))


def emitted(lists: DataFrame) -> DataFrame:
    """``document_id, revision, patch`` between each document's consecutive lists (``document_id, step, blocks``), from an empty one."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        now, revision, out = [], 0, []
        for r in rows.sort_values("step").itertuples():
            new = [dict(b) for b in r.blocks]
            for p in patches(now, new, revision):
                revision = p["revision"]
                out.append((key[0], revision, json.dumps(p, default=int, ensure_ascii=False)))
            now = new
        return pd.DataFrame(out, columns=["document_id", "revision", "patch"])

    return lists.select("document_id", "step", "blocks").groupBy("document_id").applyInPandas(fold, "document_id string, revision long, patch string")


def list_patches(lists: DataFrame) -> DataFrame:
    """``document_id, patch`` from ``document_id, revision, old, new`` (arrays of block structs)."""

    @F.pandas_udf("array<string>")
    def made(old: pd.Series, new: pd.Series, revision: pd.Series) -> pd.Series:
        plain = lambda blocks: [dict(b) for b in (blocks if blocks is not None else [])]
        return pd.Series([[json.dumps(p, default=int, ensure_ascii=False) for p in patches(plain(o), plain(n), int(r))] for o, n, r in zip(old, new, revision, strict=True)])

    return lists.select("document_id", F.posexplode(made("old", "new", "revision")).alias("step", "patch"))
