"""Passes over rows in order, and what the queries that use them cost as tables grow."""

from __future__ import annotations

import random
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from docflow.functions import align, matching
from docflow.operators import drafts, folds, overlap, replay
from docflow.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def conversations(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("CAST(conv_id AS string) AS document_id", "CAST(turn AS int) AS ord", "text")


def test_postings_are_not_sent_to_the_driver(spark):
    rows = conversations(spark)
    asked = rows.filter("ord = 1").selectExpr("document_id", "'q' AS query_id", "text AS query")
    assert "Broadcast" not in plan(overlap.meeting(rows, asked))


@pytest.mark.parametrize("name", ["j6_similarity", "dm10_retrieved_window"])
def test_texts_of_pairs_are_not_sent_to_the_driver(spark, name):
    made = catalog.QUERIES[name](spark, SF)
    assert "text#" not in "".join(line for line in plan(made).splitlines() if "BroadcastExchange" in line)
    got, want = oracle.compare(made, oracle.database(SF), catalog.ORACLES[name])
    assert got == want and want[1]


def test_scores_of_a_long_document_in_stretches(spark):
    """A document of many blocks and two queries, one without a text in common; and blocks that a query holds whole, in part, or too little of."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(3, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(100)]
    query = " - ".join(t[len(t) // 3 :] if k % 3 else t for k, t in enumerate(texts) if k % 2)
    rows = [("d", k, t) for k, t in enumerate(texts)] + [("e", k, t) for k, t in enumerate([None, "", texts[1]])]
    blocks = spark.createDataFrame(rows, "document_id string, ord int, text string")
    asked = spark.createDataFrame([("d", "q", query), ("d", "r", "XYZ " * 9), ("e", "q", None), ("e", "r", texts[1].upper())], "document_id string, query_id string, query string")
    got = {(r["document_id"], r["ord"], r["query_id"]): r["score"] for r in overlap.similarities(blocks, asked).collect()}
    want = {("d", k, "q"): align.similarity(t, query) for k, t in enumerate(texts)} | {("e", 2, "r"): align.similarity(texts[1], texts[1])}
    assert got == {k: v for k, v in want.items() if v} and 1.0 in got.values() and min(got.values()) < 1


def test_texts_are_dealt_out_and_not_their_postings(spark):
    rows = conversations(spark)
    asked = rows.filter("ord = 1").selectExpr("document_id", "'q' AS query_id", "text AS query")
    text = plan(overlap.meeting(rows, asked))
    assert text.count("MapInArrow") == 1 and text.index("MapInArrow") < text.index("SortMergeJoin")
    there = rows.join(asked.select("document_id"), "document_id", "semi")
    assert overlap.dealt(rows, asked).count() == there.count() + asked.count()


def test_many_queries_in_chunks(spark, monkeypatch):
    """Each block meets each query that it shares a run with, once, however they are dealt out; a task holds few characters of queries."""
    monkeypatch.setattr(overlap, "ASKED", 100)
    monkeypatch.setattr(overlap, "STRETCH", 7)
    monkeypatch.setattr(overlap, "POSTINGS", 5)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde", k=7)) for _ in range(30)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 6)))
    rows = [(d, k, line()) for d in "de" for k in range(40)] + [("d", 40, None), ("d", None, line()), ("f", 0, line())]
    texts = [(d, f"q{k}", line().upper()) for d in "de" for k in range(25)] + [("d", "long", "-".join(words)), ("d", "none", None), ("g", "q", line())]
    folded = lambda t: align.retrieval_text(t or "")
    runs = lambda t: {folded(t)[i : i + 12] for i in range(len(folded(t)) - 11)}
    want = sorted((d, k, q) for d, k, t in rows if k is not None for e, q, u in texts if d == e and runs(t) & runs(u))
    blocks, asked = spark.createDataFrame(rows, "document_id string, ord int, text string"), spark.createDataFrame(texts, "document_id string, query_id string, query string")
    assert sorted(tuple(r) for r in overlap.meeting(blocks, asked).collect()) == want and want
    scores = [tuple(r) for r in overlap.similarities(blocks, asked).collect()]
    of, by = {r[:2]: r[2] for r in rows}, {r[:2]: r[2] for r in texts}
    assert sorted(scores) == sorted((d, k, q, s) for d, k, q in want if (s := align.similarity(of[d, k], by[d, q])))
    held = overlap.dealt(blocks, asked).filter("ord IS NULL").selectExpr("*", "length(text) AS n").groupBy("document_id", "chunk", "stretch").agg({"n": "sum"}).collect()
    longest = max(len(t or "") for _, _, t in texts)
    assert len({r["chunk"] for r in held}) > 3 and max(r["sum(n)"] for r in held) < 100 + longest
    postings = overlap.Postings([folded(t) for _, _, t in texts], 12)
    for _, _, t in rows:
        assert postings.sharing(overlap.run_keys(folded(t), 12)) == [k for k, (_, _, u) in enumerate(texts) if runs(t) & runs(u)]


def test_matching_holds_little_of_a_long_query():
    """A short block against a query of many characters: what it takes is a few names for each of them, however often the query repeats itself."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(50)]
    query = "".join(rng.choices(words, k=10_000)) * 8
    block = query[1000:1100] + "u" + query[5000:5100]
    tracemalloc.start()
    try:
        assert align.shares([(block, query)], 12) == [200 / 201]
        assert tracemalloc.get_traced_memory()[1] < 120 * len(query)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("group", [1 << 18, 64, 5])
def test_blocks_are_those_of_the_rule_however_they_are_cut(monkeypatch, group):
    monkeypatch.setattr(matching, "GROUP", group)
    rng = random.Random(group)
    text = lambda letters: "".join(rng.choices(letters, k=rng.choice((0, 1, 7, 60, 300))))
    pairs = [(text(letters), text(letters)) for letters in ("a", "ab", "abcdefgh", "aé\U0001f600ß ") for _ in range(12)]
    pairs += [(b[:50] + a + b[-50:], b) for a, b in pairs] + [(b, "x" + b) for _, b in pairs]
    for (a, b), found in zip(pairs, matching.matching_blocks(pairs), strict=True):
        joined: list[list[int]] = []  # difflib puts blocks that touch together
        for i, j, n in found.tolist():
            if joined and (joined[-1][0] + joined[-1][2], joined[-1][1] + joined[-1][2]) == (i, j):
                joined[-1][2] += n
            else:
                joined.append([i, j, n])
        assert joined == [list(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


def test_slices_are_bounded_by_rows_and_bytes():
    small = pa.record_batch({"text": [None, "x"] * folds.ROWS})
    large = pa.record_batch({"text": ["x" * (folds.BYTES // 4)] * 20 + ["y" * (3 * folds.BYTES)]})
    for batch, least in ((small, 2), (large, 6)):
        cut = list(folds.slices([batch], ("text",)))
        assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and len(cut) >= least
        assert all(c.num_rows <= folds.ROWS and (c.num_rows == 1 or sum(len(t or "") for t in c.column("text").to_pylist()) <= 1.5 * folds.BYTES) for c in cut)


def test_claims_of_all_kinds_in_one_pass(spark):
    text = plan(catalog.QUERIES["dm11_refused_claims"](spark, SF))
    assert text.count("Scan parquet") == 1 and "InPandas" not in text


def test_rounds_without_a_table_for_each_document(spark):
    rows = [("a", k, None, f"<update xmlns='urn:docflow:document:1' schema-version='0.1'><p>{k}</p></update>") for k in range(3)] + [("b", 0, "other", "x"), ("b", 1, None, "x"), (None, 0, None, "x")]
    rounds = spark.createDataFrame(rows, "document_id string, round_index int, base_sha256 string, update_xml string")
    made = drafts.replay_rounds(rounds.repartition(3))
    assert "InPandas" not in plan(made)
    assert sorted((str(r["document_id"]), r["n_rounds"], r["valid"]) for r in made.collect()) == [("None", 0, False), ("a", 3, True), ("b", 0, False)]


def test_replay_without_a_table_for_each_document(spark):
    events = conversations(spark).selectExpr("document_id", "CAST(ord AS long) AS seq", "'document.snapshot' AS kind", """'{"blocks": [], "revision": 0, "status": "OCR"}' AS data""")
    made = replay.replay(events)
    assert "InPandas" not in plan(replay.parts_of(events, 10)) + plan(made)
    assert {r["document_id"]: r["cursor"] for r in made.collect()} == {r[0]: r[1] for r in events.groupBy("document_id").max("seq").collect()}


def test_keys_and_rows_beyond_a_slice(spark):
    n = 3 * folds.ROWS
    rows = spark.range(n).selectExpr("id % 2 AS k", "IF(id % 5 = 0, NULL, id) AS v", "id AS o").repartition(5)
    fold = lambda key, some: ((key[0], None if r.v is None else r.o) for r in some)
    got = [tuple(r) for r in folds.in_order(rows, ["k"], "o", fold, "k long, o long").collect()]
    for k in (0, 1):
        assert [o for key, o in got if key == k] == [None if i % 5 == 0 else i for i in range(k, n, 2)]
