"""Streams that stop and go on, against the batch forms."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import Row

from docflow.operators import drafts
from docflow.streaming import assembly

IMAGES = "document_id string, image_ord int, image_id string, content string, calls array<struct<content: string, finish_reason: string>>, complete boolean"


def reply(*blocks, finish="stop"):
    return json.dumps({"action": "generate", "blocks": [{"xml": x, "text": t, "ocr_refs": r} for x, t, r in blocks]}), finish


def recorded(seed):
    """Images of some documents with replies that are good, broken, cut off, repaired or missing."""
    rng = random.Random(seed)
    rows = []
    for d in range(5):
        for i in range(rng.randint(1, 4)):
            lines = [f"line {d} {i} {k}" for k in range(rng.randint(0, 3))]
            blocks = [(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p><q/>{}</p>"]).format(x), x, [f"i{i}:ocr:{k}"]) for k, x in enumerate(lines)]
            fixes = [reply((f"<p>{x}</p>", x, r)) for xml, x, r in blocks if "<q/>" in xml]
            calls = rng.choice([[reply(*blocks)], [reply(*blocks), *fixes], [reply(*blocks), ("noise", "stop"), *fixes], [reply(*blocks, finish="length")], []])
            rows.append((f"d{d}", i, f"i{i}", "".join(x + "\n" for x in lines), calls, rng.random() < 0.7))
    return rows


def run(spark, rows, path):
    spark.createDataFrame(rows, assembly.EVENT_DDL).coalesce(1).write.mode("append").parquet(f"{path}/events")
    assembly.answering(spark, f"{path}/events", path).awaitTermination(300)
    return assembly.answers(spark, path)


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_rounds_gives_the_batch_fold(spark, tmp_path, seed):
    images = spark.createDataFrame(recorded(seed), IMAGES)
    events = [tuple(r) for r in assembly.as_events(images).collect()]
    random.Random(seed).shuffle(events)
    steps = [[e[:-1] for e in events if e[-1] == 0 and e[2] != "close"], [e[:-1] for e in events if e[-1] == 1 and e[2] != "close"], [e[:-1] for e in events if e[2] == "close" or e[-1] > 1]]
    for k, rows in enumerate(steps):
        given = run(spark, rows + steps[max(k - 1, 0)], tmp_path)  # those of the step before come once more
    want = sorted(map(str, drafts.assemble(images).collect()))
    assert sorted(map(str, assembly.committed(given).collect())) == want and want
    asked = given.filter("kind = 'ask'")
    assert asked.count() == asked.select("document_id", "image_ord", "call").distinct().count()
    received = given.filter("kind = 'received'")
    assert received.count() == received.select("document_id", "image_ord", "call").distinct().count() > 0


def test_no_reply_is_asked_for_again(spark, tmp_path):
    good = reply(("<p>a</p>", "a", []), ("<p><q/></p>", "b", []))
    first = run(spark, [("d", 0, "image", None, "i0", "a\nb\n", None, True), ("d", 0, "reply", 0, None, *good, None)], tmp_path).collect()
    assert [(r["kind"], r["call"]) for r in first if r["kind"] == "ask"] == [("ask", 1)]
    second = run(spark, [("d", 0, "reply", 0, None, "another", "stop", None), ("d", 0, "reply", 1, None, *reply(("<p>b</p>", "b", [])), None), ("d", 1, "image", None, "i1", "", None, True)], tmp_path).collect()
    assert sorted((r["image_ord"], r["call"]) for r in second if r["kind"] == "ask") == [(0, 1), (1, 0)]
    assert [(r["ord"], r["text"], r["status"]) for r in sorted(second, key=lambda r: r["ord"] or 0) if r["kind"] == "block"] == [(0, "a", "ok"), (1, "b", "ok")]


def test_setting_of_the_session_comes_back(spark):
    before = spark.conf.get(assembly.PROVIDER)
    with assembly.with_state(spark):
        assert spark.conf.get(assembly.PROVIDER) == assembly.ROCKS
    assert spark.conf.get(assembly.PROVIDER) == before


class Counted:
    """A map or a value of the state store that counts its messages."""

    def __init__(self):
        self.rows, self.messages = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.messages += 1
            match name:
                case "get":
                    return self.rows.get(())
                case "update":
                    self.rows[()] = args[0]
                case "getValue":
                    return self.rows[args[0]]
                case "containsKey":
                    return args[0] in self.rows
                case "exists":
                    return bool(self.rows)
                case "updateValue":
                    self.rows[args[0]] = args[1]
                case "removeKey":
                    self.rows.pop(args[0], None)
                case "iterator":
                    return iter(list(self.rows.items()))

        return call


def test_messages_to_the_store_grow_with_the_events():
    """Two batches of a document of many images: the second one goes on from the blocks of the first."""
    made = {}
    for n in (20, 80):
        one = assembly.Assembly()
        one.at, one.calls, one.blocks = stores = Counted(), Counted(), Counted()
        texts = []
        for start in (0, n // 2):
            events = [e for i in range(start, start + n // 2) for e in ((i, "image", None, f"i{i}", "", None, True), (i, "reply", 0, None, *reply((f"<p>{i}</p>", str(i), [])), None))]
            answers = list(one.handleInputRows(("d",), iter([Row(**dict(zip(assembly.EVENT, ("d", *e), strict=True))) for e in events]), None))
            texts += [a[assembly.NAMES.index("text")] for a in answers if a[1] == "block"]
        assert texts == [str(i) for i in range(n)] and not stores[1].rows and len(stores[2].rows) == n
        made[n] = sum(s.messages for s in stores)
    assert made[80] < 5 * made[20] and made[80] < 200
