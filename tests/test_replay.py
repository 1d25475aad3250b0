"""Replay of event logs by parts against the fold event by event."""

from __future__ import annotations

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.operators import events, replay
from docflow.operators.block_list import BlockList, Edit, Reset

SCHEMA = "document_id string, seq long, kind string, data string"


def block(i, version=1, text="x"):
    return {"blockId": f"b{i}", "version": version, "xml": text}


def patch(revision, after, removed, blocks):
    return {"baseRevision": revision, "revision": revision + 1, "afterBlockId": after, "removeBlockIds": removed, "blocks": blocks}


def made_log(seed, n, faults=0.0):
    """A log of patches that fit, with some that don't, gaps, repeats, snapshots, progress and perhaps an end."""
    rng = random.Random(seed)
    now, revision, seq, fresh = [], 0, rng.randint(0, 9), 0
    log = [(seq, "document.snapshot", {"blocks": [], "revision": 0, "status": "OCR"})] if rng.random() > faults else []
    for _ in range(n):
        seq += 1
        kind = rng.random()
        if kind < 0.05:
            log.append((seq, "document.progress", {"status": "ASSEMBLY", "totalImages": 5, "completedOcrImages": rng.randint(0, 5 + (rng.random() < faults)), "completedImages": 1}))
        elif kind < 0.06 + faults / 10:
            log.append((seq, "document.snapshot", {"blocks": list(now), "revision": revision, "status": "OCR", "totalImages": 3}))
        elif kind < 0.063:
            log.append((seq, rng.choice(["document.completed", "document.failed"]), {"status": "COMPLETED"}))
        else:
            at, k = rng.randint(0, len(now)), rng.choice([0, 0, 1, 2])
            removed = now[at : at + k]
            new = [dict(b, version=b["version"] + rng.randint(0, 1)) for b in removed if rng.random() < 0.6]
            new = [dict(b, xml="new") if b["version"] > o["version"] else b for b in new for o in now if o["blockId"] == b["blockId"]]
            for _ in range(rng.choice([0, 1, 1, 2])):
                fresh += 1
                new.append(block(rng.choice([fresh, fresh, rng.randint(0, fresh)]) if faults else fresh))
            p = patch(revision + (rng.random() < faults / 20), now[at - 1]["blockId"] if at else None, [b["blockId"] for b in removed], new)
            if rng.random() < faults / 20:
                p.pop(rng.choice(list(p)))
            log.append((seq, "blocks.patch", p))
            try:
                now, revision = events.apply_patch(now, revision, p)
            except (Reset, KeyError):
                pass
        if rng.random() < faults / 10:
            log += rng.choice([[log[-1]], [(seq, "blocks.patch", patch(revision, None, [], [block(10**6)]))]])
        seq += rng.random() < faults / 30
    return log


def folded(log):
    state = events.Preview()
    for e in log:
        state = events.reduce_event(state, *e)
    return state.plain()


def by_parts(log, size, fan):
    """The parts of a log composed ``fan`` at a time, and then applied; None where they can't be."""
    cut = {}
    for e in log:
        cut.setdefault(e[0] // size, []).append(e)
    parts = [replay.Part.loads(replay.summarised(cut[k]).dumps()) for k in sorted(cut)]
    parts = [replay.Part.loads(replay.composed(parts[k : k + fan]).dumps()) for k in range(0, len(parts), fan)]
    state = events.Preview()
    try:
        for p in parts:
            state = replay.advanced(state, p)
    except (Reset, KeyError):
        return None
    return state.plain()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.integers(1, 5))
def test_parts_of_sound_logs(seed, size, fan):
    log = made_log(seed, 60)
    assert by_parts(log, size, fan) == folded(log)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 12), st.integers(1, 5), st.sampled_from([0.1, 0.5, 1.0]))
def test_parts_of_faulty_logs(seed, size, fan, faults):
    log = made_log(seed, 50, faults)
    assert by_parts(log, size, fan) in (None, folded(log))


def test_edits_compose_in_any_grouping():
    log = [e for e in made_log(3, 200) if e[1] == "blocks.patch"]
    edits = [replay.summarised([e]).edit for e in log]

    def joined(some):
        blocks = BlockList(is_open=True)
        for e in some:
            blocks.apply(Edit(*e))
        return list(blocks.edit())

    left, right = BlockList(), BlockList()
    left.apply(Edit(*joined([joined(edits[:77]), joined(edits[77:])])))
    right.apply(Edit(*joined([*edits[:20], joined([joined(edits[20:50]), *edits[50:]])])))
    assert list(left) == list(right) and len(left) > 20


def test_patches_that_do_not_fit_change_nothing():
    blocks = BlockList([block(i) for i in range(4)])
    for anchor, removed, new in ((None, ["b1"], []), ("b9", [], []), ("b0", ["b1", "b1"], []), ("b0", [], [block(2)]), ("b0", ["b1"], [block(1, 0)]), ("b0", ["b1"], [block(1, 1, "other")]), (None, [], [block(7), block(7)])):
        with pytest.raises(Reset):
            blocks.patch(anchor, removed, new)
        assert list(blocks) == [block(i) for i in range(4)]


def long_log(n):
    log = [(0, "document.snapshot", {"blocks": [], "revision": 0, "status": "OCR"})]
    for i in range(n):
        old = i % 1000
        log.append((i + 1, "blocks.patch", patch(i, f"b{old - 1}" if old else None, [f"b{old}"] if i >= 1000 else [], [block(old, i, "x" * 20)])))
    return log


def test_long_log_in_linear_time():
    seconds = []
    for n in (20_000, 100_000):
        log = long_log(n)
        began = time.process_time()
        state = folded(log)
        seconds.append(time.process_time() - began)
        assert (len(state[0]), state[1], state[2]) == (1000, n, n)
    assert seconds[1] < 15 * seconds[0] and seconds[1] < 30


def test_hot_document_over_many_tasks(spark):
    log = long_log(6000)
    rows = [("hot", s, k, json.dumps(d)) for s, k, d in log] + [("gap", s, k, json.dumps(d)) for s, k, d in log[:50] + log[60:90]] + [("odd", s, k, json.dumps(d)) for s, k, d in made_log(5, 80, 1.0)]
    table = spark.createDataFrame(rows, SCHEMA)
    parts = replay.parts_of(table, 100)
    assert parts.filter("document_id = 'hot'").count() == 61
    got = {r["document_id"]: r for r in replay.replay(table, part=100, fan=4).collect()}
    want = {r["document_id"]: r for r in replay.one_by_one(table).collect()}
    assert got == want and got["gap"]["reset"] and got["hot"]["revision"] == 6000
    assert replay.replay(table.limit(0)).collect() == []
