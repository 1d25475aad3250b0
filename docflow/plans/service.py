"""Queries of event delivery: outboxes, ends, patches and readers' states, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import blocks as B
from ..operators import drafts, evaluate, events, replay
from ..sources import versions
from ..sources.shared import scratch
from ..streaming import outbox
from .assembly import BROKEN, images, placed, reply, value
from .documents import turns
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col
PLACED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations"


def numbered(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), "turn", "role", "text", place.alias("place"))


@query("""SELECT event_id FROM (SELECT *, row_number() OVER w AS seq, lag(floor(value / 10)::INT) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    WHERE floor(value / 10)::INT IS DISTINCT FROM coalesce(before, CASE WHEN user_id % 2 = 0 THEN 0 END)""")
def st2_outbox(t: Tables) -> DataFrame:
    """Payloads that differ from the one before, or from the last one that was sent."""
    payload = F.floor(col("value") / 10).cast("int").cast("string")
    rows = t.events.select(col("user_id").cast("string").alias("document_id"), col("event_type").alias("kind"), "event_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("seq"), payload.alias("payload"))
    sent = t.events.filter("user_id % 2 = 0").select(col("user_id").cast("string").alias("document_id"), col("event_type").alias("kind"), F.sha2(F.lit("0"), 256).alias("signature")).distinct()
    return events.outbox(rows, sent).select("event_id")


@query("""WITH sent AS (SELECT event_id, user_id, event_type, seq FROM (SELECT *, row_number() OVER w AS seq, lag(floor(value / 10)::INT) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE floor(value / 10)::INT IS DISTINCT FROM before)
    SELECT event_id, seq = max(seq) OVER (PARTITION BY user_id, event_type) AS in_state, CASE WHEN seq <= 3 THEN 1 WHEN seq <= 9 THEN 2 ELSE 3 END::BIGINT AS version FROM sent""")
def st2_outbox_with_state(t: Tables) -> DataFrame:
    """A stream that sends payloads which differ from the one before, in three batches: the rows of each version's outbox, and which of them are the
    state after the last one."""
    payload = F.floor(col("value") / 10).cast("int").cast("string")
    rows = t.events.select(col("user_id").cast("string").alias("document_id"), col("event_type").alias("kind"), "event_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long").alias("seq"), payload.alias("payload"))
    path = scratch(t.spark, "outbox")
    for part in ("seq <= 3", "seq > 3 AND seq <= 9", "seq > 9"):
        rows.filter(part).write.mode("append").parquet(f"{path}/payloads")
        sent = outbox.sending(t.spark.readStream.schema(rows.schema).parquet(f"{path}/payloads"), path)
        sent.awaitTermination()
        outbox.sender(path)(rows.filter(part), 0)  # a batch that comes again is left out
    columns = "document_id string, kind string, event_id long, seq long"
    made = [versions.table(t.spark, path, "outbox", columns, k).withColumn("version", F.lit(k).cast("long")) for k in (1, 2, 3)]
    each = made[2].drop("version").join(made[0].unionByName(made[1]).groupBy("event_id").agg(F.min("version").alias("version")), "event_id", "left").withColumn("version", F.coalesce("version", F.lit(3).cast("long")))
    last = outbox.state(t.spark, path).select("document_id", "kind", "seq", F.lit(True).alias("last"))
    return each.join(last, ["document_id", "kind", "seq"], "left").select("event_id", F.coalesce("last", F.lit(False)).alias("in_state"), "version")


@query(f"""SELECT conv_id::VARCHAR AS document_id, (place + 1)::BIGINT AS revision, CASE WHEN place > 0 THEN 'b' || (place - 1) END AS after, 'b' || place AS block FROM ({PLACED})""")
def st4_emitted_patches(t: Tables) -> DataFrame:
    """Patches between lists that grow by a block each."""
    rows = numbered(t)
    block = F.struct(F.concat(F.lit("b"), "place").alias("blockId"), F.lit(1).alias("version"), F.col("text").alias("xml"))
    lists = rows.select("document_id", col("place").alias("step"), F.array_sort(F.collect_list(F.struct("place", block.alias("b"))).over(W.partitionBy("document_id").orderBy("place"))).alias("l"))
    made = events.emitted(lists.select("document_id", "step", F.transform("l", lambda x: x["b"]).alias("blocks")))
    return made.select("document_id", "revision", F.get_json_object("patch", "$.afterBlockId").alias("after"), F.get_json_object("patch", "$.blocks[0].blockId").alias("block"))


@query("""SELECT event_id, CASE WHEN seq = 1 THEN 'applied' WHEN event_type = 'error' THEN 'ignored' WHEN first_type <> 'error' AND event_type = first_type THEN 'same' ELSE 'error' END AS outcome
    FROM (SELECT *, row_number() OVER w AS seq, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def st6_ends(t: Tables) -> DataFrame:
    """Transitions to an end: errors stand for failures, every other kind for a completion with that kind as its result."""
    rows = t.events.select(col("user_id").alias("document_id"), "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.when(col("event_type") == "error", "fail").otherwise("complete").alias("kind"), col("event_type").alias("result"))
    return events.ended(rows).select("event_id", "outcome")


@query("""SELECT user_id AS document_id, CASE WHEN user_id % 5 = 0 THEN 'gone' WHEN user_id % 5 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'end' ELSE 'events' END ELSE CASE WHEN user_id % 5 - 2 = k AND user_id % 2 = 0 THEN 'end' WHEN user_id % 5 - 2 > k THEN 'gone' ELSE 'events' END END AS answer FROM (SELECT user_id, count(*) AS k FROM events GROUP BY 1)""")
def st7_resumption(t: Tables) -> DataFrame:
    """Readers that ask for more than there is, for all of it, or at its end."""
    heads = t.events.groupBy(col("user_id").alias("document_id")).agg(F.count("*").alias("last"), F.lit(True).alias("terminal")).withColumn("terminal", col("document_id") % 2 == 0)
    rest = col("document_id") % 5
    cursors = heads.select("document_id", F.when(rest == 0, col("last") + 1).when(rest == 1, col("last")).otherwise(rest - 2).alias("cursor"))
    return events.resumption(cursors, heads).select("document_id", "answer")


def logged(t: Tables, ends: Column) -> DataFrame:
    """Events of each conversation: an empty snapshot, a patch for each turn, and an end where ``ends`` holds."""
    rows = numbered(t)
    one = lambda seq, kind, data: (seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), data.alias("data"))
    start = rows.filter("place = 0").select("document_id", *one(F.lit(0), "document.snapshot", F.lit('{"blocks": [], "revision": 0, "status": "OCR"}')))
    block = F.struct(F.concat(F.lit("b"), "place").alias("blockId"), F.lit(1).alias("version"), col("role").alias("xml"))
    after = F.when(col("place") > 0, F.concat(F.lit("b"), col("place") - 1))
    patch = F.to_json(F.struct(col("place").alias("baseRevision"), (col("place") + 1).alias("revision"), after.alias("afterBlockId"), F.array().cast("array<string>").alias("removeBlockIds"), F.array(block).alias("blocks")))
    patches = rows.select("document_id", *one(col("place") + 1, "blocks.patch", patch))
    end = rows.groupBy("document_id").agg(F.count("*").alias("k")).filter(ends).select("document_id", *one(col("k") + 1, "document.completed", F.lit('{"status": "COMPLETED"}')))
    return start.union(patches).union(end)


@query(f"""SELECT conv_id::VARCHAR AS document_id, (max(place) + CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS cursor, count(*)::BIGINT AS revision, CASE WHEN conv_id % 2 = 0 THEN 'COMPLETED' ELSE 'OCR' END AS status,
    '[' || string_agg('{{"blockId": "b' || place || '", "version": 1, "xml": "' || role || '"}}', ', ' ORDER BY place) || ']' AS blocks, false AS reset FROM ({PLACED}) GROUP BY conv_id""")
def st8_replay(t: Tables) -> DataFrame:
    """Readers' states after a snapshot, a patch for each turn, and an end for some."""
    return replay.replay(logged(t, col("document_id").cast("long") % 2 == 0)).select("document_id", "cursor", "revision", "status", "blocks", "reset")


@query(f"""SELECT conv_id::VARCHAR AS document_id, (min(k) > 1) AS reset, CASE WHEN min(k) > 1 THEN 1 ELSE 2 END::BIGINT AS cursor FROM ({PLACED}) GROUP BY conv_id""")
def st8_gaps(t: Tables) -> DataFrame:
    """Logs that lack their second patch: their readers have to start afresh."""
    return replay.replay(logged(t, F.lit(True)).filter("seq <> 2 OR kind <> 'blocks.patch'")).select("document_id", "reset", "cursor")


@query(f"""SELECT conv_id::VARCHAR AS document_id, 'i' || place AS image_id, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS n_repairs, 1 AS n_applied FROM ({PLACED})""")
def st14_replayed_calls(t: Tables) -> DataFrame:
    """Recorded replies folded again: those that were cut off or can't be read have counted, and none is asked for twice."""
    rows, rest = placed(t), col("turn") % 3
    good = reply(value(col("line")))
    cut = F.struct(good["content"].alias("content"), F.lit("length").alias("finish_reason"))
    noise = F.struct(F.lit("[]").alias("content"), F.lit("stop").alias("finish_reason"))
    second, third = F.when(rest == 0, good).otherwise(cut), F.when(rest == 1, good).otherwise(noise)
    return drafts.assembly_log(images(rows, reply(value(col("line"), F.lit(BROKEN))), second, third, good)).select("document_id", "image_id", "n_repairs", "n_applied")


@query(f"""SELECT conv_id::VARCHAR AS document_id, string_agg('## ' || place || ' ok' || chr(10) || chr(10) || repeat('`', 3 + place::INT % 4) || chr(10) || repeat('`', 2 + place::INT % 4) || text || chr(10) || repeat('`', 3 + place::INT % 4) || chr(10), chr(10) ORDER BY place) AS report FROM ({PLACED}) GROUP BY conv_id""")
def sk9_report(t: Tables) -> DataFrame:
    """A Markdown report of each document, with fences longer than what its texts have."""
    body = F.concat(F.expr("repeat('`', cast(2 + place % 4 AS int))"), "text")
    return B.block_report(numbered(t).select("document_id", col("place").alias("ord"), F.lit("ok").alias("status"), body.alias("text")))


ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


@query(rf"""SELECT conv_id::VARCHAR AS document_id, string_agg('<p>' || {ESCAPED} || '</p>', chr(10) ORDER BY turn) AS html, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS plain FROM conversations GROUP BY 1""")
def sk10_render(t: Tables) -> DataFrame:
    """Documents as HTML and plain text."""
    return B.rendered(B.documents(turns(t))).select("document_id", "html", "plain")


@query(f"""SELECT conv_id::VARCHAR AS document_id, 0 AS step, 1::BIGINT AS n_removed, 'b0' AS first_removed, 1::BIGINT AS revision FROM ({PLACED}) WHERE place = 0 AND k = 2
    UNION ALL SELECT conv_id::VARCHAR, 0, k - 1, 'b0', 1 FROM ({PLACED}) WHERE place = 0 AND k > 2""")
def so7_patches(t: Tables) -> DataFrame:
    """Patches from a list without its last block to one without its first, all blocks of a new version: one patch replaces them."""
    rows = numbered(t)
    block = lambda v: F.struct(F.concat(F.lit("b"), "place").alias("blockId"), F.lit(v).alias("version"), col("role").alias("xml"))
    lists = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", block(1).alias("a"), block(2).alias("b")))).alias("l"))
    n = F.size("l")
    made = lists.filter(n > 1).select("document_id", F.lit(0).alias("revision"), F.slice(F.transform("l", lambda x: x["a"]), 1, n - 1).alias("old"), F.slice(F.transform("l", lambda x: x["b"]), 2, F.greatest(n - 1, F.lit(0))).alias("new"))
    removed = F.from_json(F.get_json_object("patch", "$.removeBlockIds"), "array<string>")
    return events.list_patches(made).select("document_id", "step", F.size(removed).cast("long").alias("n_removed"), F.try_element_at(removed, F.lit(1)).alias("first_removed"), F.get_json_object("patch", "$.revision").cast("long").alias("revision"))


CHECKS = "SELECT unnest(['numbering', 'terminal', 'versions', 'grammar', 'export', 'digest']) AS name, unnest([1, 2, 3, 4, 5, 6]) AS c"


@query(f"""SELECT conv_id::VARCHAR AS document_id, name, conv_id % 7 <> c AS passed FROM (SELECT DISTINCT conv_id FROM conversations), ({CHECKS})""")
def dm24_verification(t: Tables) -> DataFrame:
    """Named checks of each document against its export; most documents break one of them."""
    fault = col("document_id").cast("long") % 7
    rows = numbered(t).select(
        "document_id", F.when((fault == 1) & (col("place") == 0), -1).otherwise(col("place")).alias("ord"), F.when(fault == 3, -1).otherwise(0).alias("version"),
        F.when(fault == 2, "pending").otherwise("ok").alias("status"), F.when(fault == 4, F.concat(F.lit("<q>"), T.escaped(col("text")), F.lit("</q>"))).otherwise(T.paragraph(col("text"))).alias("xml"),
    )
    made = B.documents(rows).select("document_id", F.when(fault == 5, F.concat("xml", F.lit(" "))).otherwise(col("xml")).alias("xml"))
    return evaluate.verification(rows, made.select("document_id", "xml", F.when(fault == 6, "other").otherwise(T.sha256(col("xml"))).alias("sha256")))


@query("""WITH d AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT conv_id::VARCHAR AS document_id, 'actual_prompt_tokens:' || turn AS name, turn % 5 <> 2 AS passed FROM conversations WHERE turn % 3 <> 1
    UNION ALL SELECT conv_id::VARCHAR, 'phase_metrics_available', conv_id % 3 <> 0 FROM d
    UNION ALL SELECT conv_id::VARCHAR, 'phase_cleanup:' || p, conv_id % 4 <> p + 1 OR conv_id % 5 = 0 FROM d, (VALUES (0), (1)) v(p) WHERE conv_id % 3 <> 0""")
def dm24_run_evidence(t: Tables) -> DataFrame:
    """Evidence of the runs: prompts with as many tokens as were counted, figures of each phase, and memory that was given back; some documents lack it."""
    calls = t.conversations.select(
        col("conv_id").cast("string").alias("document_id"), col("turn").cast("string").alias("call_id"), F.length("text").alias("inspected_tokens"),
        F.when(col("turn") % 3 != 1, F.length("text") + F.when(col("turn") % 5 == 2, 1).otherwise(0)).alias("prompt_tokens"),
    )
    docs = t.conversations.select("conv_id", col("conv_id").cast("string").alias("document_id")).distinct()
    phases = docs.filter("conv_id % 3 <> 0").withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    phases = phases.select("document_id", "phase", (col("conv_id") % 4 != col("phase") + 1).alias("cleanup_verified"), F.when(col("conv_id") % 5 == 0, "2026-01-01").alias("recovery_verified_at"))
    return evaluate.run_evidence(docs, calls, phases)


@query(r"""SELECT conv_id::VARCHAR AS document_id, CASE conv_id % 5 WHEN 0 THEN false WHEN 4 THEN false ELSE true END AS needs_review FROM conversations GROUP BY 1, conv_id""")
def ag6_document_review(t: Tables) -> DataFrame:
    """Documents with a block that isn't ok, recognition that isn't complete, or a low ratio; unknown ratios don't count."""
    rows, fault = numbered(t), col("document_id").cast("long") % 5
    blocks = rows.select("document_id", F.when((fault == 1) & (col("place") == 0), "fallback").otherwise("ok").alias("status"))
    ocr = rows.select("document_id", (~((fault == 2) & (col("place") == 0))).alias("complete"))
    ratios = rows.select("document_id", F.when(fault == 3, 0.79).when(fault == 0, 0.8).cast("double").alias("coverage"), F.lit(None).cast("double").alias("support"))
    return evaluate.needs_review(blocks, ocr, ratios, rows.filter("place < 0").select("document_id"))


@query(f"""SELECT conv_id::VARCHAR AS document_id, check_id, n AS actual, CASE check_id WHEN 'bold' THEN n >= 1 ELSE n BETWEEN 0 AND 2 END AS passed FROM
    (SELECT conv_id, check_id, count(*) FILTER (WHERE CASE check_id WHEN 'bold' THEN place % 2 = 0 ELSE role = 'user' AND place % 2 = 1 END)::INT AS n FROM ({PLACED}), (VALUES ('bold'), ('content')) v(check_id) GROUP BY 1, 2)""")
def ag5_visual_checks(t: Tables) -> DataFrame:
    """Visual checks: at least one bold block, and no more than two plain ones of one kind of image."""
    rows = numbered(t).select("document_id", col("place").cast("int").alias("ord"), col("role").alias("image_id"), F.when(col("place") % 2 == 0, F.lit("<p><b>x</b></p>")).otherwise(F.lit("<p>plain</p>")).alias("xml"))
    checks = [{"id": "bold", "kind": "bold", "pattern": "x"}, {"id": "content", "kind": "content", "pattern": "^plain$", "image_id": "user", "min": 0, "max": 2}]
    return B.matching_nodes(rows, checks).select("document_id", "check_id", col("actual").cast("int").alias("actual"), "passed")
