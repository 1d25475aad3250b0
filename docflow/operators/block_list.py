"""An ordered list of blocks under patches, as links by id, and what a run of patches does to a list that isn't known yet.

A patch costs what it names, not the list. An *open* list knows only what patches have said of it: which blocks there must be,
which of them follow each other, which ids must be free. What it has become is an :class:`Edit`: those needs, and what is put in
place of what. Edits compose, so that parts of a long log can be folded apart, and each is applied as a whole where its needs hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple


class Reset(Exception):
    """The reader must take a fresh snapshot."""


class Follows(NamedTuple):
    """Whatever comes after a block (None: first of all) in the list that isn't known."""

    of: str | None


class Edit(NamedTuple):
    """``there``: ids of blocks that must be there; ``follows``: pairs that must stand next to each other; ``free``: ids that must not be there; ``older``:
    blocks that replace ones there, which must not be newer; ``splices``: after which block (None: first) what goes and what comes."""

    there: list[str]
    follows: list[list]
    free: list[str]
    older: dict[str, dict]
    splices: list[list]


class BlockList:
    """Blocks by id, each with the id of the next one. A closed list knows all its blocks, an open one those it has heard of."""

    def __init__(self, blocks: Iterable[dict] = (), is_open: bool = False) -> None:
        self.is_open = is_open
        self.next: dict[str | None, str | Follows | None] = {None: Follows(None) if is_open else None}
        #: Blocks that are there; None for one that is known by its id alone.
        self.there: dict[str, dict | None] = {}
        #: Of an open list: blocks of the unknown list that still stand and that don't, what follows what in it, and which of its places are taken.
        self.kept: dict[str, None] = {}
        self.gone: set[str] = set()
        self.away: set[str] = set()
        self.after: dict[str | None, str] = {}
        self.linked: set[str] = set()
        self.asked: dict[str, None] = {}
        self.free: dict[str, None] = {}
        self.older: dict[str, dict] = {}
        self.link(None, list(blocks))

    def __iter__(self) -> Iterator[dict]:
        at = self.next[None]
        while at is not None:
            yield self.there[at]
            at = self.next[at]

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other)

    def __len__(self) -> int:
        return len(self.there)

    def link(self, anchor: str | None, blocks: list[dict]) -> None:
        last = self.next[anchor]
        for b in blocks:
            self.next[anchor] = anchor = b["blockId"]
            self.there[anchor] = b
            self.next[anchor] = last

    def unlink(self, anchor: str | None, ids: list[str]) -> None:
        if ids:
            self.next[anchor] = self.next[ids[-1]]
        for i in ids:
            del self.there[i], self.next[i]
            if i in self.kept:
                del self.kept[i]
                self.gone.add(i)
            if self.is_open:
                self.away.add(i)

    def heard(self, i: str) -> None:
        self.there[i] = self.kept[i] = None
        self.next[i] = Follows(i)

    def need(self, i: str) -> None:
        """There must be a block of this id."""
        if i in self.there:
            return
        if not self.is_open or i in self.away:
            raise Reset("anchor")
        self.heard(i)
        self.asked[i] = None

    def need_next(self, i: str | None, j: str) -> None:
        """What follows one block must be another one."""
        now = self.next[i]
        if isinstance(now, Follows):
            if j in self.away or j in self.linked or (j in self.there and j not in self.kept):
                raise Reset("splice")
            if j not in self.there:
                self.heard(j)
            self.after[now.of] = self.next[i] = j
            self.linked.add(j)
        elif now != j:
            raise Reset("splice")

    def need_older(self, b: dict) -> None:
        """A block that is there must not be newer than this one, nor unlike it at the same version."""
        was = self.there[b["blockId"]]
        if was is None:
            self.older.setdefault(b["blockId"], b)
        elif b["version"] < was["version"] or (b["version"] == was["version"] and b != was):
            raise Reset("version")

    def need_free(self, i: str) -> None:
        if i in self.there:
            raise Reset("identity")
        if self.is_open and i not in self.away:
            self.free[i] = None

    def patch(self, anchor: str | None, removed: list[str], blocks: list[dict]) -> None:
        """A patch, whole or (:class:`Reset`) not at all; an open list must not be used after that."""
        if anchor is not None:
            self.need(anchor)
        for i, j in zip([anchor, *removed], removed, strict=False):
            self.need_next(i, j)
        ids = [b["blockId"] for b in blocks]
        leaving = set(removed)
        if len(set(ids)) < len(ids) or len(leaving) < len(removed):
            raise Reset("identity")
        for b in blocks:
            if b["blockId"] in self.there:
                self.need_older(b)
            if b["blockId"] not in leaving:
                self.need_free(b["blockId"])
        self.unlink(anchor, removed)
        self.link(anchor, blocks)

    def edit(self) -> Edit:
        """What an open list has become."""
        splices = []
        for start in (None, *self.kept):
            new, at = [], self.next[start]
            while isinstance(at, str) and at not in self.kept:
                new.append(self.there[at])
                at = self.next[at]
            old, at = [], self.after.get(start)
            while at in self.gone:
                old.append(at)
                at = self.after.get(at)
            if old or new:
                splices.append([start, old, new])
        return Edit(list(self.asked), [[i, j] for i, j in self.after.items()], list(self.free), self.older, splices)

    def apply(self, edit: Edit) -> None:
        """An edit; where its needs don't hold (:class:`Reset`), the list must not be used any more."""
        for i in edit.there:
            self.need(i)
        for i, j in edit.follows:
            if i is not None:
                self.need(i)
            self.need_next(i, j)
        for i in edit.free:
            self.need_free(i)
        for b in edit.older.values():
            self.need_older(b)
        for anchor, old, _ in edit.splices:
            self.unlink(anchor, old)
        for anchor, _, new in edit.splices:
            self.link(anchor, new)
