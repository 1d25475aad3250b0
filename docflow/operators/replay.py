"""Readers' states after long logs: parts of a document's log are folded apart, and what they do is put together.

A log is cut by sequence into parts. Of each part is kept what it asks of the state before it, what it changes, and the state
after its last snapshot, which no longer depends on anything before. Parts next to each other compose, so that a
hot document is folded by many tasks, over as many levels as its length asks for. A document with a patch that doesn't fit is
folded event by event instead, since only that shows where its reader stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import folds
from .block_list import BlockList, Edit, Reset
from .events import STATE_DDL, TERMINAL, Preview, as_row, progress_of, reduce_event

#: Events of a part, by sequence, and parts that are composed by one task.
PART, FAN = 4096, 64


@dataclass
class Part:
    """``first`` and ``last``: the sequence of events that follow on each other, ``stuck`` if a gap comes after them; ``base``: the revision that they need, ``steps`` from it on;
    ``progress`` and ``end``: what they set; ``absolute``: the state after the rest of the part, from its first snapshot on."""

    first: int | None = None
    last: int | None = None
    stuck: bool = False
    base: int | None = None
    steps: int = 0
    edit: list | None = None
    progress: list | None = None
    end: str | None = None
    absolute: list | None = None
    broken: bool = False

    def dumps(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Part:
        return cls(**json.loads(text))


def summarised(events: list[tuple[int, str, dict]]) -> Part:
    """What a part of a log does, its events in order."""
    part, blocks, state = Part(), BlockList(is_open=True), None
    for seq, kind, data in events:
        if state is not None:
            state = reduce_event(state, seq, kind, data)
        elif kind == "document.snapshot":
            state = reduce_event(Preview(), seq, kind, data)
        elif part.broken or part.end or part.stuck or (part.last is not None and seq <= part.last):
            continue
        elif part.last is not None and seq != part.last + 1:
            part.stuck = True
        else:
            try:
                match kind:
                    case "blocks.patch":
                        if (part.base is not None and data["baseRevision"] != part.base + part.steps) or data["revision"] != data["baseRevision"] + 1:
                            raise Reset("revision")
                        blocks.patch(data.get("afterBlockId"), data["removeBlockIds"], data["blocks"])
                        part.base, part.steps = data["baseRevision"] if part.base is None else part.base, part.steps + 1
                    case "document.progress":
                        part.progress = list(progress_of(data))
                    case "document.completed" | "document.failed":
                        part.end = kind.rpartition(".")[2].upper()
                    case _:
                        raise Reset("kind")
            except (Reset, KeyError):
                part.broken = True
                continue
            part.first, part.last = seq if part.first is None else part.first, seq
    if not part.broken:
        part.edit = list(blocks.edit())
    part.absolute = None if state is None else state.plain()
    return part


def advanced(state: Preview, part: Part) -> Preview:
    """A state after a part, which takes over its blocks; :class:`Reset` where the part has to be folded event by event."""
    if state.status in TERMINAL:
        return state
    if part.broken:
        raise Reset("part")
    if part.first is not None:
        if state.cursor is None or part.first != state.cursor + 1:
            state = state._replace(reset=True)
        else:
            if part.base not in (None, state.revision):
                raise Reset("revision")
            state.blocks.apply(Edit(*part.edit))
            status, total, ocr, images = part.progress or (state.status, state.total, state.ocr, state.images)
            state = state._replace(revision=state.revision + part.steps, cursor=part.last, status=part.end or status, total=total, ocr=ocr, images=images, reset=state.reset or part.stuck)
            if part.end:
                return state
    return state if part.absolute is None else Preview.restored(part.absolute)


def composed(parts: list[Part]) -> Part:
    """One part that does what several in order do."""
    made, blocks = parts[0], None
    for part in parts[1:]:
        if made.broken or part.broken:
            made.broken = True
        elif made.absolute is not None:
            try:
                made.absolute = advanced(Preview.restored(made.absolute), part).plain()
            except (Reset, KeyError):
                made.broken = True
        elif made.first is None:
            made = part
        elif made.end or made.stuck or part.first != made.last + 1:
            made.stuck, made.absolute = made.stuck or (not made.end and part.first is not None), part.absolute
        else:
            if blocks is None:
                blocks = BlockList(is_open=True)
                blocks.apply(Edit(*made.edit))
            try:
                if None not in (made.base, part.base) and part.base != made.base + made.steps:
                    raise Reset("revision")
                blocks.apply(Edit(*part.edit))
            except (Reset, KeyError):
                made.broken = True
                continue
            made.base, made.steps = part.base if made.base is None else made.base, made.steps + part.steps
            made.progress, made.last, made.end, made.stuck, made.absolute = part.progress or made.progress, part.last, part.end, part.stuck, part.absolute
    if blocks is not None and not made.broken:
        made.edit = list(blocks.edit())
    return made


PARTS_DDL = "document_id string, part long, summary string"
RESULT_DDL = f"{STATE_DDL}, broken boolean"


def parts_of(events: DataFrame, size: int) -> DataFrame:
    """``document_id, part, summary`` of events (``document_id, seq, kind, data`` as JSON)."""

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield *key, summarised([(r.seq, r.kind, json.loads(r.data)) for r in rows]).dumps()

    cut = events.select("document_id", F.floor(F.col("seq") / size).alias("part"), "seq", "kind", "data")
    return folds.in_order(cut, ["document_id", "part"], "seq", fold, PARTS_DDL)


def level_up(parts: DataFrame, fan: int) -> DataFrame:
    """Each ``fan`` parts of a document composed into one."""

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        yield *key, composed([Part.loads(r.summary) for r in rows]).dumps()

    some = parts.select("document_id", F.floor(F.col("part") / fan).alias("upper"), "part", "summary")
    return folds.in_order(some, ["document_id", "upper"], "part", fold, PARTS_DDL)


def finished(parts: DataFrame) -> DataFrame:
    """Each document's state after its few last parts; ``broken`` where it isn't that."""

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state, broken = Preview(), False
        try:
            for r in rows:
                state = advanced(state, Part.loads(r.summary))
        except (Reset, KeyError):
            state, broken = Preview(), True
        yield *as_row(key[0], state), broken

    return folds.in_order(parts, ["document_id"], "part", fold, RESULT_DDL)


def one_by_one(events: DataFrame) -> DataFrame:
    """Each document's state, folded event by event in one task."""

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state = Preview()
        for r in rows:
            state = reduce_event(state, r.seq, r.kind, json.loads(r.data))
        yield as_row(key[0], state)

    return folds.in_order(events.select("document_id", "seq", "kind", "data"), ["document_id"], "seq", fold, STATE_DDL)


def replay(events: DataFrame, part: int = PART, fan: int = FAN) -> DataFrame:
    """Each document's state after all its events (``document_id, seq, kind, data`` as JSON; a sequence is dense, repeats are ignored)."""
    parts = stored(parts_of(events, part), "parts")
    longest = parts.agg(F.max("part") - F.min("part")).first()[0] or 0
    while longest >= fan:
        parts = level_up(parts, fan)
        longest //= fan
    states = stored(finished(parts), "replayed")
    broken = states.filter("broken").select("document_id")
    if broken.isEmpty():
        return states.drop("broken")
    return states.filter("NOT broken").drop("broken").union(one_by_one(events.join(broken, "document_id", "left_semi")))
