"""Alignment, blocks, drafts, overlap and events on small cases."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.functions import align, tree
from docflow.operators import blocks, drafts, events, overlap, replay, requests, service
from docflow.sources import files, sinks
from docflow.sources.versions import Conflict

P = "<p>{}</p>"


def value(text, xml=None, refs=()):
    return {"xml": xml or P.format(text), "text": text, "ocr_refs": list(refs)}


# Alignment


@given(st.text("ab c", max_size=30), st.text("ab c", max_size=30))
@settings(max_examples=60, deadline=None)
def test_alignment_bounds(a, b):
    matched, coverage, support = align.alignment(a, b)
    x, y = align.squeezed(a), align.squeezed(b)
    assert matched == sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    assert (coverage is None) == (not x) and (support is None) == (not y)


@given(st.text("ab c", max_size=30), st.text("ab c", max_size=40), st.integers(0, 6))
@settings(max_examples=80, deadline=None)
def test_similarity_by_the_library(block, query, least):
    x, y = align.retrieval_text(block), align.retrieval_text(query)
    sizes = [m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()]
    assert align.similarity(block, query, least) == (sum(sizes) / max(len(x), 1) if max(sizes) >= least else 0.0)


def test_content_check():
    text = "abcdefghijklmnopqrst"
    found = align.content_check(tree.envelope(P.format(text[:-2])), None, text)
    assert not found["errors"] and found["needs_review"]
    tail = "x" * 400
    lost = align.content_check(tree.envelope(P.format(tail)), P.format(tail), "wholly different words")
    assert lost["source_coverage"] == 0 and "CONTENT_MISMATCH" in lost["errors"]


@pytest.mark.parametrize(("tail", "three", "two", "kept"), [(768, 1536, 1000, "BCD"), (769, 1000, 900, "D"), (768, 1537, 1536, "CD"), (768, 1537, 1537, "D"), (1536, 9000, 9000, "D")])
def test_context_suffix(tail, three, two, kept):
    sizes = {"D": tail, "B\nC\nD": three, "C\nD": two}
    assert "".join(align.context_suffix(list("ABCD"), sizes.get, 99_999)) == kept


def test_source_lines_number_blank_ones():
    assert align.source_lines("ab\n\ncde\n", "i") == [("i:ocr:0", 0, 3, "ab\n"), ("i:ocr:2", 4, 8, "cde\n")]


def test_window_shrinks_to_a_line():
    assert align.half_window("abc\ndefgh", 0, 9) == 4
    plan = align.plan_window("x" * 100, 0, 100, ["h" * 50], None, "r" * 50, len, {"context": 700, "output": 600, "margin": 50})
    assert plan == {"end": 100, "output": 550, "history": 0, "previous": False}


# Blocks


@pytest.mark.parametrize(
    ("text", "xml", "relation", "gate"),
    [
        ("<|im_start|>words<|im_end|>", P.format("words"), "code_or_control_label_difference", False),
        ("a: b", P.format("a： b"), "uncertain_difference", False),
        ("  x", "<pre><code>\tx\n</code></pre>", "code_or_control_label_difference", False),
        ("x\ny", "<pre><code>x\n\ny</code></pre>", "code_whitespace_difference", False),
        ("---- words -----", P.format("words"), "xml_is_text_substring", False),
        ("words 1234567", P.format("words"), "xml_is_text_substring", False),
        ("words 12345678", P.format("words"), "xml_is_text_substring", True),
        ("rule", "<hr/>", "non_text_separator", False),
        ("heading", "<h2/>", "xml_is_text_substring", False),
        ("heading!", "<h2/>", "xml_is_text_substring", True),
    ],
)
def test_relation(text, xml, relation, gate):
    found = blocks.relation(text, tree.block_of(xml))
    assert (found["relation"], found["hard_gate"]) == (relation, gate)


def test_blank_link_is_an_error_of_candidates_only():
    assert blocks.candidate(value("x", "<p><a href=' '>x</a></p>"), "i", "0")["current_errors"][0]["code"] == "LINK_TARGET_EMPTY"
    assert blocks.candidate(value("x", "<p><a href='#f'>x</a></p>"), "i", "0")["status"] == "ok"


def test_proposals():
    assert blocks.proposal('{"action": "generate"}', "length") == (None, "INCOMPLETE")
    assert blocks.proposal("[]", "stop")[1] == "NOT_OBJECT" and blocks.proposal("{", "stop")[1] == "NOT_JSON"
    assert blocks.proposal('{"action": "generate"}', "stop")[0] == {"action": "generate"}
    assert blocks.response_schema("repair")["additionalProperties"] is False


def test_repair_option_only_for_the_bare_case():
    code = "<blockquote><pre><code> x\n</code></pre></blockquote>"
    target = blocks.candidate(value(" x\n", code), "i", "0")
    option = blocks.repair_options(target)[0]
    assert option["blocks"][0]["xml"] == "<pre><code> x\n</code></pre>"
    for xml in (code.replace("<blockquote>", "<blockquote id='1'>"), code.replace("</pre>", "</pre>more"), code.replace("<pre>", "<p>a</p><pre>")):
        assert blocks.repair_options(blocks.candidate(value(" x\n", xml), "i", "0")) == []
    versions = {target["id"]: 0}
    choice = {"option_id": option["option_id"], "target_versions": versions}
    assert blocks.chosen_option(choice, [option], versions)[0] is option
    assert blocks.chosen_option(choice, [option], {target["id"]: 1})[1] == "STALE"
    assert blocks.chosen_option({"option_id": "x"}, [option], versions)[1] == "NOT_OFFERED"


@pytest.mark.parametrize("text", ["in short", " x \n", "x\n", " x", None])
def test_no_repair_option_for_text_that_is_not_the_code(text):
    code = "<blockquote><pre><code> x\n</code></pre></blockquote>"
    assert blocks.repair_options(blocks.candidate(value(text, code), "i", "0")) == []


# Drafts

LINES = align.source_lines("one\ntwo\nthree\n", "i")


def pending(text, refs):
    return {"xml": "<p><q/></p>", "text": text, "ocr_refs": refs}


def opened(values, tail=None, continued=None):
    return drafts.begin("i", {"blocks": values, "tail": continued}, tail)


def resolved(values, reserved=()):
    draft = opened(values)
    drafts.resolve(draft, LINES, set(reserved))
    return [(r["status"], r["fallback_source"], r["text"]) for r in draft.rows]


def test_fallback_rules():
    shared = [pending("A", ["i:ocr:0"]), pending("B", ["i:ocr:0"]), pending("C", ["nope"])]
    assert [x[1] for x in resolved(shared)] == ["vlm_text"] * 3
    assert resolved([pending("A", ["i:ocr:2", "i:ocr:0"])]) == [("fallback", "ocr", "one\nthree")]
    assert resolved([pending("A", ["i:ocr:0"])], ["i:ocr:0"])[0][1] == "vlm_text"
    for refs in (None, "x", [1], ["i:ocr:0", "i:ocr:0"]):
        assert resolved([pending("A", refs)])[0][1] == "vlm_text"
    assert resolved([pending("", [])]) == [("unresolved", None, None)]


def repair(draft, *values, **more):
    made = drafts.attempt(draft, drafts.queue(draft)[0])
    drafts.splice(draft, made, {"attempt_id": made.name, "target_versions": made.versions, "blocks": list(values)} | more)
    return made


def test_splice_keeps_content_and_ids():
    draft = opened([value("good text"), pending("bad text", [])])
    with pytest.raises(drafts.Rejected, match="CONTENT"):
        repair(draft, value("other"))
    drafts.failed(draft, draft.running, "CONTENT")
    made = repair(draft, value("bad "), value("text"))
    assert [(r["status"], r["version"], r["repair_attempts"]) for r in draft.rows] == [("ok", 0, 0), ("ok", 1, 2), ("ok", 0, 2)]
    assert draft.rows[2]["lineage"] == draft.rows[1]["lineage"] == [draft.rows[1]["id"]]
    with pytest.raises(drafts.Rejected, match="INACTIVE"):
        drafts.splice(draft, made, {"attempt_id": made.name, "target_versions": made.versions, "blocks": [value("bad text")]})
    assert len(drafts.commit([], draft)) == 3
    with pytest.raises(drafts.Rejected):
        drafts.commit([], draft)


@pytest.mark.parametrize(
    ("more", "code"),
    [({"attempt_id": "other"}, "SCOPE"), ({"target_versions": {}}, "SCOPE"), ({"blocks": []}, "EMPTY"), ({"blocks": None}, "EMPTY"), ({"tail": value("x")}, "EMPTY")],
)
def test_splices_out_of_scope(more, code):
    draft = opened([pending("bad text", [])])
    before = [dict(r) for r in draft.rows]
    with pytest.raises(drafts.Rejected, match=code):
        repair(draft, value("bad text"), **more)
    assert [r["xml"] for r in draft.rows] == [r["xml"] for r in before] and draft.running


def test_known_text_stays_in_order_where_some_was_missing():
    draft = opened([pending(None, []), pending("known", [])])
    draft.rows[0]["current_errors"][0]["target_blocks"] = [r["id"] for r in draft.rows]
    assert drafts.queue(draft) == [[r["id"] for r in draft.rows]]
    with pytest.raises(drafts.Rejected, match="CONTENT"):
        repair(draft, value("found knwon"))
    drafts.failed(draft, draft.running, "x")
    repair(draft, value("found"), value("known"))
    assert not draft.failed


@given(st.lists(st.sampled_from(["a\n", " b", "c c"]), min_size=1, max_size=5), st.data())
@settings(max_examples=60, deadline=None)
def test_code_may_be_put_together_but_not_changed(codes, data):
    block = lambda code: {"xml": f"<pre><code>{code}</code></pre>", "text": code, "ocr_refs": []}
    joined = "".join(codes)
    draft = opened([block(joined)])
    made = drafts.Attempt("n", "repair", [draft.rows[0]["id"]], {}, [])
    assert not drafts.Splice(draft, made, {"blocks": [block(c) for c in codes]}).loses_code()
    at = data.draw(st.integers(0, len(joined) - 1))
    changed = joined[:at] + joined[at + 1 :]
    assert not changed or drafts.Splice(draft, made, {"blocks": [block(changed)]}).loses_code()


def test_groups_of_failures():
    draft = opened([pending(str(k), []) for k in range(6)])
    ids = [r["id"] for r in draft.rows]
    draft.rows[4]["status"] = "ok"
    draft.rows[0]["current_errors"][0]["target_blocks"] = [ids[2], ids[4], "gone"]
    assert drafts.queue(draft) == [ids[0:3], ids[3:4], ids[5:6]]


def test_budget_is_shared_by_descent():
    draft = opened([pending("bad", [])])
    for _ in range(drafts.MAX_REPAIRS):
        drafts.failed(draft, drafts.attempt(draft, drafts.queue(draft)[0]), "X")
    assert len(draft.rows[0]["current_errors"]) > drafts.MAX_REPAIRS
    with pytest.raises(drafts.Rejected, match="BUDGET"):
        drafts.attempt(draft, drafts.queue(draft)[0])


def test_replies_that_cannot_be_read_give_one_whole_block():
    done, draft = drafts.fold_image("i", [("{}", "length")], LINES, [])
    assert [(b["status"], b["text"]) for b in done] == [("fallback", "one\ntwo\nthree")] and draft.warnings == ["INCOMPLETE"]
    done, _ = drafts.fold_image("i", [("x", "stop")], [], [])
    assert [b["status"] for b in done] == ["unresolved"]
    done, _ = drafts.fold_image("i", [("x", "stop")], LINES, [], complete=False)
    assert [b["status"] for b in done] == ["fallback", "unresolved"]


def reply(blocks_=(), **more):
    return json.dumps({"action": "generate", "blocks": list(blocks_)} | more), "stop"


def continued(*calls, first="old end"):
    before, _ = drafts.fold_image("h", [reply([value("before"), value(first)])], [], [])
    done, draft = drafts.fold_image("i", list(calls), LINES, before)
    assert [b["id"] for b in done[:2]] == [b["id"] for b in before]
    return done[1:], draft


def test_tail_is_continued_under_its_id():
    done, _ = continued(reply([value("next")], tail=value("old end goes on", refs=["i:ocr:0"])))
    assert [(b["text"], b["version"], b["ocr_refs"]) for b in done] == [("old end goes on", 1, ["i:ocr:0"]), ("next", 0, [])]


def test_tail_that_loses_text_is_repaired_or_restored():
    lost = reply([], tail=value("end goes on"))
    done, draft = continued(lost)
    assert [(b["text"], b["version"], b["status"]) for b in done] == [("old end", 0, "ok"), (None, 0, "unresolved")]
    done, _ = continued(lost, reply([value("old end"), value(" and on")]))  # a repair has to keep the candidate's own text
    assert done[0]["version"] == 0 and len(done) == 2
    # a reply whose structure fails keeps the text after the tail only
    for refs, source in ((["i:ocr:0"], "ocr"), (["i:ocr:1"], "vlm_text"), ([], "vlm_text")):
        done, _ = continued(reply([], tail={"xml": "<q/>", "text": "old endone", "ocr_refs": refs}))
        assert [(b["text"], b["version"], b["fallback_source"]) for b in done] == [("old end", 0, None), ("one", 0, source)]


def test_repairs_of_a_tail_keep_it_in_front():
    broken = reply([], tail={"xml": "<q/>", "text": "old end more", "ocr_refs": []})
    done, draft = continued(broken, reply([value("old end"), value(" more")]))
    assert [(b["text"], b["version"]) for b in done] == [("old end", 1), (" more", 0)] and draft.log[0].outcome == "applied"
    done, draft = continued(broken, reply([value("old "), value("end more")]))
    assert draft.log[0].outcome == "TAIL_CONTENT_LOSS" and done[0]["version"] == 0


def test_tail_outside_of_scope():
    assert drafts.fold_image("i", [reply([], tail=value("x"))], LINES, [])[1].warnings == ["TAIL_SCOPE"]


def test_a_title_stands_first_or_becomes_text():
    title = {"xml": "<title>T</title>", "text": "T", "ocr_refs": []}
    done, _ = drafts.fold_image("i", [reply([title, value("a")])], [], [])
    assert [b["status"] for b in done] == ["ok", "ok"]
    done, _ = drafts.fold_image("j", [reply([title])], [], done)
    assert [b["status"] for b in done] == ["ok", "ok", "fallback"] and done[2]["xml"] == "<p>T</p>"


def test_assembly_and_rounds(spark):
    reply = json.dumps({"action": "generate", "blocks": [value("one"), value("two three")]})
    images = spark.createDataFrame([("d", 0, "i", "one\ntwo\n", [(reply, "stop")]), ("d", 1, "j", "", [("?", "stop")])], "document_id string, image_ord int, image_id string, content string, calls array<struct<content:string,finish_reason:string>>")
    out = drafts.assemble(images).orderBy("ord")
    assert [(r["ord"], r["status"]) for r in out.collect()] == [(0, "ok"), (1, "ok"), (2, "unresolved")]
    doc = blocks.documents(out).first()
    assert doc["xml_status"] == "partial" and not tree.validate(doc["xml"], "document")
    updates = [("d", k, None, tree.envelope(x)) for k, x in enumerate(("<p>a</p>", "<p>a b</p><p>c</p>", "<p>c</p><hr/>"))]
    chain = drafts.replay_rounds(spark.createDataFrame(updates, "document_id string, round_index int, base_sha256 string, update_xml string")).first()
    assert chain["valid"] and chain["xml"] == tree.envelope("<p>a b</p><p>c</p><hr/>", "document")


# Overlap

LONG = "A body of text that is long enough to be evidence of a repeat."


def committed(*values):
    return [dict(blocks.candidate(v, "old", str(i)), status="ok") for i, v in enumerate(values)]


def claimed(history, count=2, **more):
    return {"relation": overlap.RELATION, "candidate_prefix_count": count, "history_refs": [overlap.history_ref(b, i) for i, b in enumerate(history)], "first_history_match": "full_block"} | more


def outcome(history, values, claim=None):
    draft = drafts.begin("new", {"blocks": values})
    sent = {overlap.history_ref(b, i): (i, b) for i, b in enumerate(history)}
    code = overlap.bind(draft, claim or claimed(history), sent, history) or overlap.resolve(draft, history)
    return code, len(draft.rows)


def test_proven_repeat_is_left_out():
    old = committed(value("Title", "<h2>Title</h2>"), value(LONG))
    new = [value("Title", "<h2>Title</h2>"), value(LONG), value("something new")]
    assert outcome(old, new) == (None, 1)
    changed = [new[0], value(LONG.replace("long", "wrong")), new[2]]
    assert outcome(old, changed) == ("OVERLAP_CONTENT_CONFLICT", 3)
    short = committed(value("Title", "<h2>Title</h2>"), value("brief"))
    assert outcome(short, [new[0], value("brief"), new[2]])[0] == "OVERLAP_EVIDENCE_TOO_SHORT"


def test_only_blocks_that_passed_are_evidence():
    old = committed(value("Title", "<h2>Title</h2>"), value(LONG))
    new = [value("Title", "<h2>Title</h2>"), value(LONG), value("something new")]
    old[1]["status"] = "fallback"
    assert outcome(old, new) == ("OVERLAP_BLOCK_UNVERIFIED", 3)
    draft = drafts.begin("new", {"blocks": [new[0], pending(LONG, []), new[2]]})
    old[1]["status"] = "ok"
    sent = {overlap.history_ref(b, i): (i, b) for i, b in enumerate(old)}
    assert overlap.bind(draft, claimed(old), sent, old) is None
    assert overlap.resolve(draft, old) == "OVERLAP_DEFERRED"
    drafts.resolve(draft, [], set())
    assert overlap.resolve(draft, old) == "OVERLAP_BLOCK_UNVERIFIED" and len(draft.rows) == 3
    assert overlap.bind(draft, claimed(old), sent, old) is None
    assert overlap.bind(draft, claimed(old, 1), sent, old) == "OVERLAP_REBIND_REJECTED"


def test_end_of_the_first_block():
    code = lambda c: value(c, f"<pre><code>{c}</code></pre>")
    old = committed(code("a = 1\n  b = 2\n"), value(LONG))
    cut = claimed(old, first_history_match="suffix_of_first_history")
    assert outcome(old, [code("  b = 2\n"), value(LONG)], cut) == (None, 0)
    assert outcome(old, [code("b = 2\n"), value(LONG)], cut) == ("OVERLAP_CONTENT_CONFLICT", 2)
    old = committed(value("The start and the end"), value(LONG))
    cut = claimed(old, first_history_match="suffix_of_first_history")
    assert outcome(old, [value("the end"), value(LONG)], cut) == (None, 0)
    assert outcome(old, [value("an end"), value(LONG)], cut) == ("OVERLAP_CONTENT_CONFLICT", 2)


def test_overlap_in_assembly():
    first, _ = drafts.fold_image("a", [reply([value("Title", "<h2>Title</h2>"), value(LONG)])], [], [])
    values = [value("Title", "<h2>Title</h2>"), value(LONG), value("something new")]
    done, draft = drafts.fold_image("b", [reply(values, overlap_claim=claimed(first))], [], first)
    assert [b["text"] for b in done] == ["Title", LONG, "something new"] and len(draft.omitted) == 2 and draft.applied
    done, draft = drafts.fold_image("b", [reply(values, overlap_claim=claimed(first, 9))], [], first)
    assert len(done) == 5 and draft.warnings == ["OVERLAP_CLAIM_INVALID"]


@pytest.mark.parametrize("fault", [{"candidate_prefix_count": -1}, {"candidate_prefix_count": True}, {"relation": "other"}, {"extra": 1}, {"history_refs": ["h0", "h0"]}, {"whole_image_has_no_new_content": True}])
def test_malformed_claims_lose_nothing(fault):
    old = committed(value("Title", "<h2>Title</h2>"), value(LONG))
    new = [value("Title", "<h2>Title</h2>"), value(LONG), value("something new")]
    assert outcome(old, new, claimed(old, **fault)) == ("OVERLAP_CLAIM_INVALID", 3)
    reverse = claimed(old) | {"history_refs": claimed(old)["history_refs"][::-1]}
    assert outcome(old, new, reverse)[0] == "OVERLAP_HISTORY_NOT_CONTIGUOUS"
    assert outcome(old, new, claimed(old) | {"history_refs": ["unknown"]})[0] == "OVERLAP_HISTORY_INVALID"


def test_retrieval_window(spark):
    text = ["the first block of some length", "the second block of some length", "the third block of some length", "unlike"]
    rows = [("d", i, "a" if i < 3 else "b", "ok", t) for i, t in enumerate(text)]
    history = spark.createDataFrame(rows, "document_id string, ord int, image_id string, status string, text string")
    queries = spark.createDataFrame([("d", "q", " ".join(text[:3]).replace("second", "sexond"))], "document_id string, query_id string, text string")
    got = overlap.retrieve(history, queries).first()
    assert (got["first_ord"], got["n_blocks"]) == (0, 3)


# Events


def listed(ids):
    return [{"blockId": x[0], "version": int(x[1:] or 1), "xml": x} for x in ids]


@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), unique=True), st.lists(st.sampled_from(["a", "b2", "c", "e"]), unique=True))
def test_patches_give_the_new_list(old, new):
    now, revision = listed(old), 7
    for p in events.patches(now, listed(new), 7):
        now, revision = events.apply_patch(now, revision, p)
    assert now == listed(new)


def test_reducer():
    snap = {"blocks": listed("abc"), "revision": 1, "status": "ASSEMBLING"}
    s = events.reduce_event(events.Preview(), 10, "document.snapshot", snap)
    insert = {"baseRevision": 1, "revision": 2, "afterBlockId": "a", "removeBlockIds": [], "blocks": listed("x")}
    s = events.reduce_event(s, 11, "blocks.patch", insert)
    assert ([b["blockId"] for b in s.blocks], s.revision, s.cursor) == (list("axbc"), 2, 11)
    assert events.reduce_event(s, 11, "blocks.patch", insert) == s
    assert events.reduce_event(s, 13, "blocks.patch", insert).reset
    for fault in ({"baseRevision": 1}, {"afterBlockId": "zz"}, {"removeBlockIds": ["c"]}, {"blocks": listed("b")}):
        assert events.reduce_event(s, 12, "blocks.patch", insert | {"baseRevision": 2, "revision": 3} | fault).reset
    done = events.reduce_event(s, 12, "document.completed", {"status": "COMPLETED"})
    assert events.reduce_event(done, 13, "document.snapshot", snap) == done


def test_replay_and_stream(spark, tmp_path):
    from docflow.streaming import preview

    snap = {"blocks": listed("a"), "revision": 0, "status": "OCR"}
    patch = {"baseRevision": 0, "revision": 1, "afterBlockId": "a", "removeBlockIds": [], "blocks": listed("b")}
    rows = [("d", 1, "document.snapshot", json.dumps(snap)), ("d", 2, "blocks.patch", json.dumps(patch)), ("d", 3, "document.completed", '{"status": "COMPLETED"}')]
    schema = "document_id string, seq long, kind string, data string"
    batch = replay.replay(spark.createDataFrame(rows, schema)).first()
    assert (batch["status"], batch["cursor"], batch["revision"]) == ("COMPLETED", 3, 1)
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = preview.preview_states(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("states").collect()] == [tuple(batch)]


def test_versions_and_receipts(spark):
    known = spark.createDataFrame([("d", "a", "x", 1, True), ("d", "b", "y", 2, False), ("d", "c", "z", 1, True)], "document_id string, block_id string, xml string, version long, active boolean")
    wanted = spark.createDataFrame([("d", "a", "x2"), ("d", "b", "y"), ("d", "n", "n")], "document_id string, block_id string, xml string")
    got = {r["block_id"]: (r["version"], r["active"]) for r in events.block_versions(wanted, known).collect()}
    assert got == {"a": (2, True), "b": (3, True), "c": (1, False), "n": (1, True)}
    sent = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "2"), ("e", "1")], "document_id string, source_id string")
    out = events.consume(sent, sent.filter("source_id = '2'"), spark.createDataFrame([("e",)], "document_id string"))
    assert sorted(map(tuple, out.collect())) == [("d", "1", False), ("e", "1", True)]


def test_checks_over_blocks(spark):
    rows = [("d", 0, "a", "<p><a href='x'>link</a></p>"), ("d", 1, "a", "<p><span background-color='yellow'>mark</span></p>"), ("d", 2, "b", "<p>words</p>"), ("d", 3, "b", "<p>words</p>")]
    checks = [{"id": "h", "kind": "highlight", "pattern": "mark"}, {"id": "c", "kind": "content", "pattern": "words", "image_id": "b", "max": 1}, {"id": "l", "kind": "link", "pattern": "."}]
    got = {r["check_id"]: (r["actual"], r["block_ids"], r["passed"]) for r in blocks.matching_nodes(spark.createDataFrame(rows, "document_id string, ord int, image_id string, xml string"), checks).collect()}
    assert got == {"h": (1, [1], True), "c": (2, [2, 3], False), "l": (1, [0], True)}
    with pytest.raises(ValueError):
        blocks.matching_nodes(None, checks + checks)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    first = sinks.export(spark.range(3), path, 0)
    for wrong in (0, 2):
        with pytest.raises(Conflict):
            sinks.export(spark.range(4), path, wrong)
    assert sinks.export(spark.range(4), path, first) != first
    assert [sinks.exported(spark, path, "id long", v).count() for v in (first, None)] == [3, 4]
    assert sinks.filled("a @X@", {"X": "b"}) == "a b"
    with pytest.raises(ValueError):
        sinks.filled("@Y@", {})


# Service


def test_requests_beyond_a_document_are_errors(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "document_id string, ord int, text string")
    asked = spark.createDataFrame([("r", "d", [1, 0])], "request_id string, document_id string, ordinals array<int>")
    assert [(r["place"], r["text"]) for r in service.read_blocks(rows, asked).orderBy("place").collect()] == [(0, "b"), (1, "a")]
    with pytest.raises(Exception, match="no block 2"):
        service.read_blocks(rows, asked.selectExpr("request_id", "document_id", "array(2) AS ordinals")).collect()


def test_a_request_shows_retrieved_blocks_once_and_offers_options(spark):
    schema = "document_id string, ord int, id string, version int, xml string, text string, status string"
    history = spark.createDataFrame([("d", i, f"b{i}", 0, "<title>t</title>" if i == 0 else "<p>x</p>", "x", "ok") for i in range(6)], schema)
    draft = history.filter("ord < 2").selectExpr("*", "ord = 1 AS target")
    retrieved = history.filter("ord IN (1, 4)").select("document_id", "ord")
    options = spark.createDataFrame([("d", "o", "<p>x</p>")], "document_id string, option_id string, xml string")
    made = requests.contexts(draft, history, retrieved, options).first()
    shown = {k: [b["ord"] for b in made[k]] for k in ("targets", "neighbours", "recent", "retrieved")}
    assert shown == {"targets": [1], "neighbours": [0], "recent": [3, 4], "retrieved": [1]} and made["tail"]["ord"] == 5
    assert made["has_title"] and made["history_blocks"] == 6 and made["mode"] == "choose"
    assert requests.contexts(draft.withColumn("target", F.lit(False)), history).first()["mode"] == "generate"


def test_templates_and_readings(spark):
    one = spark.range(1)
    assert one.select(sinks.filled_column("@A@ and @B@", {"A": F.lit("x"), "B": F.col("id")})).first()[0] == "x and 0"
    with pytest.raises(ValueError):
        sinks.filled_column("@C@", {})
    lines = spark.createDataFrame([(0, "17 MiB, 20 MiB"), (1, "3,4")], "sample int, line string")
    assert [tuple(r) for r in files.memory_samples(lines).orderBy("sample").collect()] == [(0, 17, 20), (1, 3, 4)]
    with pytest.raises(Exception, match="no reading"):
        files.memory_samples(lines.selectExpr("sample", "'N/A' AS line")).collect()


def test_examples_must_be_single_valid_blocks(spark):
    rows = spark.createDataFrame([("a", "<p>x</p>")], "topic string, xml string")
    assert blocks.examples(rows).count() == 1 and blocks.examples(rows).first()["xml"] == "<p>x</p>"
    with pytest.raises(Exception, match="not one valid block"):
        blocks.examples(rows.selectExpr("topic", "concat(xml, xml) AS xml")).collect()
