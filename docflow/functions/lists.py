"""From one list of ids to another by the fewest moves."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def longest_rising(values: Sequence[int]) -> list[int]:
    """The places of a longest rising subsequence, by piles whose tops rise."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1], ends[k : k + 1] = [v], [i]
        before[i] = ends[k - 1] if k else -1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def edit_steps(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, str, str | None]]:
    """``(step, id, after)`` that make the list ``new`` of ``old``, in order: deletes, then inserts and moves behind an id (None: first). Ids are
    distinct in a list; those that stay in place are as many as can, so that moves are the fewest."""
    place = {x: i for i, x in enumerate(old)}
    wanted = set(new)
    kept = [x for x in new if x in place]
    still = {kept[i] for i in longest_rising([place[x] for x in kept])}
    steps: list[tuple[str, str, str | None]] = [("delete", x, None) for x in old if x not in wanted]
    before = None
    for x in new:
        if x not in still:
            steps.append(("move" if x in place else "insert", x, before))
        before = x
    return steps
