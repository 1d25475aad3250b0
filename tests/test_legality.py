"""Documents checked block by block, against the check of their whole text."""

from __future__ import annotations

import random

from docflow.functions import tree
from docflow.operators import blocks

PARTS = ["<p>x</p>", "<p>x</p>", "<p>x</p>", "<h1>x</h1>", "<title>t</title>", "<p> </p>", "<p><q/></p>", "<unknown/>", "<hr/>", "<ul><li>a</li></ul>", "<p>a</p><p>b</p>", "text", "<p>open", "", "<table><tbody><tr><td rowspan='9'>1</td></tr></tbody></table>"]


def made(seed, sound):
    rng = random.Random(seed)
    some = rng.sample(PARTS, rng.randint(1, 4))
    some = [s for s in some if s not in ("<p>a</p><p>b</p>", "text", "<p>open", "")] or PARTS[:1] if sound else some
    return [rng.choice(some + PARTS[:3]) for _ in range(rng.randint(1, 12))]


def rows_of(spark, lists):
    rows = [(str(d), 3 * k + 1, x) for d, some in enumerate(lists) for k, x in enumerate(some)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "document_id string, ord int, xml string").repartition(3)


def test_issues_of_whole_documents(spark):
    lists = [made(s, s % 3 > 0) for s in range(120)] + [["<title>t</title>"], ["<title>t</title>", "<title>t</title>", "<p>x</p>", "<title>t</title>"], ["<p> </p>", "<p>x</p>", "<unknown/>"]]
    got = sorted((r["document_id"], str(r["block_index"]), r["stage"], r["code"]) for r in blocks.document_checks(rows_of(spark, lists)).collect())
    assert got == sorted((str(d), str(i.block_index), i.stage, i.code) for d, some in enumerate(lists) for i in tree.document_issues(some))
    assert len(got) > 50


def test_visible_candidates(spark):
    lists = [made(s, s % 3 > 0) for s in range(200, 320)]
    want = []
    for d, some in enumerate(lists):
        shown = []
        for k, x in enumerate(some):
            if tree.block_of(x) is not None and not tree.document_issues([*(some[j] for j in shown), x]):
                shown.append(k)
        want += [(str(d), 3 * k + 1, n) for n, k in enumerate(shown)]
    assert sorted(map(tuple, blocks.visible(rows_of(spark, lists)).collect())) == sorted(want)


def test_places_of_a_long_document(spark):
    rows = spark.range(50_000).selectExpr("IF(id % 10 = 0, 'short', 'long') AS document_id", "CAST(id * 2 AS int) AS ord")
    placed = blocks.places(rows, span=1000)
    assert "stretch" not in placed.columns
    for name, step in (("short", 10), ("long", None)):
        got = [tuple(r) for r in placed.filter(placed.document_id == name).orderBy("ord").select("ord", "place").collect()]
        assert [p for _, p in got] == list(range(len(got)))
        assert step is None or [o for o, _ in got] == list(range(0, 100_000, 2 * step))


def test_no_blocks(spark):
    empty = rows_of(spark, [])
    assert blocks.document_checks(empty).collect() == [] and blocks.visible(empty).collect() == []
