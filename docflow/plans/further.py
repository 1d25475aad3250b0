"""Further queries, one for each operator that the other modules use only in passing, with their SQL."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import png, register
from ..functions import text as T
from ..operators import blocks as B
from ..operators import events, overlap
from ..operators.block_list import BlockList
from ..sources import files, sinks
from ..sources.shared import scratch
from ..sources.versions import Conflict
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col
PLACED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations"


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 8 >= 4 THEN h ELSE w END::BIGINT AS width, CASE WHEN n_nationkey % 8 >= 4 THEN w ELSE h END::BIGINT AS height FROM (SELECT n_nationkey, 300 + n_nationkey * 17 AS w, 70000 + n_nationkey AS h FROM nation)")
def sc5_image_sizes(t: Tables) -> DataFrame:
    """Sizes from the heads of PNG files, as the images are shown."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(300 + col("n_nationkey") * 17), number(70000 + col("n_nationkey")), F.unhex(F.lit("0802000000")))
    width, height = T.png_size(head)
    rows = t.nation.select("n_nationkey", width.alias("w"), height.alias("h"))
    width, height = T.oriented(col("w"), col("h"), col("n_nationkey") % 8 + 1)
    return rows.select("n_nationkey", width.alias("width"), height.alias("height"))


@query("SELECT o_orderkey AS sample, (o_orderkey % 16000)::BIGINT AS used, 16000::BIGINT AS total FROM orders")
def sc11_memory_samples(t: Tables) -> DataFrame:
    """Readings of a device's memory, with and without units."""
    unit = F.when(col("o_orderkey") % 2 == 0, " MiB").otherwise("")
    return files.memory_samples(t.orders.select(col("o_orderkey").alias("sample"), F.concat((col("o_orderkey") % 16000).cast("string"), unit, F.lit(", 16000"), unit).alias("line")))


@query("SELECT n_nationkey, '{' || chr(10) || '  \"id\": ' || n_nationkey || ',' || chr(10) || '  \"name\": \"é ' || n_name || '\"' || chr(10) || '}' || chr(10) AS json FROM nation")
def sk2_pretty_json(t: Tables) -> DataFrame:
    """Indented JSON with other scripts as they are and a line end."""

    @F.pandas_udf("string")
    def pretty(key: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([sinks.pretty({"id": int(k), "name": f"é {n}"}) for k, n in zip(key, name, strict=True)])

    return t.nation.select("n_nationkey", pretty("n_nationkey", "n_name").alias("json"))


@query("SELECT s_suppkey, s_name FROM supplier")
def sk4_exclusive(t: Tables) -> DataFrame:
    """A target that four writers want at once: one of them gets it, and its rows are whole."""
    path = scratch(t.spark, "exclusive")
    rows = t.supplier.select("s_suppkey", "s_name")

    def wanted(k: int) -> bool:
        try:
            sinks.publish(rows, path)
        except Conflict:
            return False
        return True

    with ThreadPoolExecutor(4) as writers:
        if sum(writers.map(wanted, range(4))) != 1:
            raise AssertionError("not one writer got through")
    return sinks.exported(t.spark, path, "s_suppkey long, s_name string")


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'insert' WHEN b.o_custkey IS NULL THEN 'delete' WHEN a.p = b.p THEN 'keep' ELSE 'update' END AS step, b.p AS value
    FROM (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey""")
def sk11_reconciled(t: Tables) -> DataFrame:
    """What to do to a shown list so that it becomes the new one."""
    side = lambda k: t.orders.filter(col("o_orderkey") % 4 == k).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("value"))
    return events.reconciled(side(0), side(1), ["o_custkey"], "value")


@query(f"""WITH b AS ({PLACED}), k AS (SELECT conv_id, count(*) AS k FROM b GROUP BY 1)
    SELECT conv_id::VARCHAR AS document_id, [0, 1] AS ords FROM k WHERE k > 1 AND conv_id % 3 = 0""")
def j3_claimed_history(t: Tables) -> DataFrame:
    """Claims on two blocks: whole ones, some with a reference that wasn't sent, some whose block has changed since."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), "conv_id", place.alias("ord"), F.lit(0).alias("version"), F.lit("i").alias("image_id"), "text", F.lit("ok").alias("status"), T.paragraph(col("text")).alias("xml"))
    sent = overlap.history_views(rows.drop("conv_id"))
    claims = sent.filter("ord < 2").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "history_ref"))).alias("r")).select("document_id", F.lit("c").alias("claim_id"), F.transform("r", lambda x: x["history_ref"]).alias("refs")).filter("size(refs) = 2")
    claims = claims.withColumn("refs", F.when(col("document_id").cast("long") % 3 == 1, F.array(F.lit("h0v0:none"), col("refs")[1])).otherwise(col("refs")))
    changed = (col("document_id").cast("long") % 3 == 2) & (col("ord") == 1)
    committed = overlap.history_views(rows.drop("conv_id").withColumn("version", F.when(changed, 1).otherwise(0)))
    return overlap.claimed_history(claims, sent.select("document_id", "history_ref", "ord"), committed).select("document_id", "ords")


GRIDS = ["<td>a</td><td>b</td>|<td>c</td><td>d</td>", "<td rowspan='2'>a</td><td>b</td>|<td>c</td>", "<td rowspan='3'>a</td>|<td>b</td>", "<td colspan='2'>a</td>|<td>b</td>", "<td colspan='2' rowspan='2'>a</td>|", "<td>a</td>|<td>b</td><td>c</td>", "<td>a</td><td rowspan='2'>b</td>|<td colspan='2'>c</td>"]
CODES = [None, None, "TABLE_SPAN_INVALID", "TABLE_GRID_INVALID", None, "TABLE_GRID_INVALID", "TABLE_SPAN_INVALID"]


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {k} THEN {'NULL' if c is None else repr(c)}" for k, c in enumerate(CODES)) + " END AS code FROM conversations")
def wf11_grids(t: Tables) -> DataFrame:
    """Tables swept row by row: full grids, with and without spans, and those with a gap, an overlap or a span too far."""
    grid = F.element_at(F.array(*(F.lit("<table><tbody>" + "".join(f"<tr>{row}</tr>" for row in g.split("|")) + "</tbody></table>") for g in GRIDS)), ((col("conv_id") + col("turn")) % 7 + 1).cast("int"))
    return B.validated(t.conversations.select("conv_id", "turn", T.update(grid).alias("xml"))).select("conv_id", "turn", "check.code")


@query("SELECT doc_id, CASE WHEN strpos(head, chr(10)) > 0 THEN length(head) - strpos(reverse(head), chr(10)) + 1 ELSE middle END::BIGINT AS cut FROM (SELECT doc_id, substr(text, 1, middle + 1) AS head, middle FROM (SELECT doc_id, text, length(text) // 2 AS middle FROM documents))")
def wf12_half_windows(t: Tables) -> DataFrame:
    """Half of each text, back to the line end before it."""
    return t.documents.select("doc_id", T.half_window(col("text"), F.lit(0), F.length("text")).cast("long").alias("cut"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)::BIGINT AS place FROM orders")
def tk5_created_order(t: Tables) -> DataFrame:
    """Members by the time of their creation, then by their own order."""
    return t.orders.select("o_orderkey", F.row_number().over(W.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE contains(text, 'on')) WHERE r <= 3")
def tk6_first_hits(t: Tables) -> DataFrame:
    """The first three hits of a search in each source."""
    hits = t.documents.filter(col("text").contains("on")).select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("r"))
    return hits.filter("r <= 3").select("source", "doc_id")


@query(r"SELECT doc_id, nullif(regexp_extract_all(text, '[0-9]+')[-1], '') AS last FROM documents")
def tk7_latest_match(t: Tables) -> DataFrame:
    """The last match of a pattern; null without any."""
    return t.documents.select("doc_id", F.try_element_at(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), F.lit(-1)).alias("last"))


@query(f"SELECT conv_id::VARCHAR AS document_id, string_agg('b' || place || ':' || (1 + place % 2), ',' ORDER BY place) AS blocks FROM ({PLACED}) GROUP BY 1")
def so8_applied_patches(t: Tables) -> DataFrame:
    """Lists that grow and then have every second block renewed, as the patches between them rebuild them."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), place.alias("place"))
    block = lambda v: F.struct(F.concat(F.lit("b"), "place").alias("blockId"), v.cast("int").alias("version"), F.lit("x").alias("xml"))
    whole = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", block(F.lit(1)).alias("a"), block(1 + col("place") % 2).alias("b")))).alias("l"))
    steps = whole.select("document_id", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.slice(F.transform("l", lambda x: x["a"]), 1, 1).alias("blocks")), F.struct(F.lit(1).alias("step"), F.transform("l", lambda x: x["a"]).alias("blocks")), F.struct(F.lit(2).alias("step"), F.transform("l", lambda x: x["b"]).alias("blocks")))).alias("s"))
    patches = events.emitted(steps.select("document_id", "s.step", "s.blocks"))

    def fold(key, found: pd.DataFrame) -> pd.DataFrame:
        now, revision = BlockList(), 0
        for p in found.sort_values("revision")["patch"]:
            revision = events.patch_onto(now, revision, json.loads(p))
        return pd.DataFrame([(key[0], ",".join(f"{b['blockId']}:{b['version']}" for b in now))], columns=["document_id", "blocks"])

    return patches.groupBy("document_id").applyInPandas(fold, "document_id string, blocks string")


@query(r"SELECT conv_id, turn, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS n FROM conversations")
def sf6_nonspace_count(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.nonspace_count(col("text")).cast("long").alias("n"))


SAID = ("a span needs a color", "Inline nesting", "pre holds one code", "a BLOCKQUOTE is too deep", "the table has a gap", "", "a ROW too many")


@query(f"""WITH m AS (SELECT conv_id, turn, lower(text || ' ' || CASE turn % 7 {' '.join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(SAID))} END) AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(s, 'color|inline|nesting|style') THEN 'style' WHEN regexp_matches(s, 'pre|blockquote|code') THEN 'structure' WHEN regexp_matches(s, 'table|row|cell|span|column') THEN 'table' ELSE 'paragraph' END AS topic FROM m""")
def dm7_advice(t: Tables) -> DataFrame:
    """The topics that advise on messages: turns with a complaint behind them."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (col("turn") % 7 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", B.advice_topic(F.concat("text", F.lit(" "), said)).alias("topic"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'tail' WHEN 3 THEN 'action,tail,blocks,attempt_id,target_versions' ELSE '' END AS missing, CASE WHEN turn % 4 = 2 THEN 'note' ELSE '' END AS extra,
    CASE WHEN turn % 4 <> 3 THEN text END AS text, CASE WHEN turn % 4 <> 3 THEN turn END AS version FROM conversations""")
def dm27_reply_fields(t: Tables) -> DataFrame:
    """Replies to repairs read by the schema that they were asked for: whole ones, some without a field, some with one too many, and some that are no object."""
    fields = [F.lit("repair").alias("action"), F.array(F.struct(F.lit("<p>x</p>").alias("xml"), "text", F.array().cast("array<string>").alias("ocr_refs"))).alias("blocks"), F.lit("a").alias("attempt_id"), F.create_map(F.lit("b"), "turn").alias("target_versions")]
    tail = F.lit("null").alias("tail")
    kinds = [F.to_json(F.struct(*fields, *more)) for more in ([tail], [], [tail, F.lit(1).alias("note")])]
    content = F.when(col("turn") % 4 == 0, kinds[0]).when(col("turn") % 4 == 1, kinds[1]).when(col("turn") % 4 == 2, kinds[2]).otherwise("[1]")
    found = B.parsed_replies(t.conversations.select("conv_id", "turn", content.alias("content")), "repair")
    listed = lambda c: F.array_join(c, ",").alias(c)
    return found.select("conv_id", "turn", listed("missing"), listed("extra"), F.try_element_at("reply.blocks", F.lit(1))["text"].alias("text"), F.try_element_at("reply.target_versions", F.lit("b")).alias("version"))


STATES = ["CAPTURING", "NORMALIZING", "READY", "UPLOADED"]


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'UPLOADED' WHEN bool_or(event_type = 'error') THEN 'READY' WHEN bool_or(event_type = 'click') THEN 'NORMALIZING' ELSE 'CAPTURING' END AS state FROM events GROUP BY 1""")
def st9_page_states(t: Tables) -> DataFrame:
    """Pages' states after all their events: a state never goes back, and the last one stays."""
    kinds = {"purchase": 3, "error": 2, "click": 1}
    state = F.lit(STATES[0])
    for kind, k in kinds.items():
        state = F.when(col("event_type") == kind, STATES[k]).otherwise(state)
    ordered = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", state.alias("s")))).alias("e"))
    last = F.aggregate("e", F.lit(STATES[0]), lambda now, x: T.advanced_state(now, x["s"], STATES, STATES[-1:]))
    return ordered.select("user_id", last.alias("state"))


@query("SELECT user_id AS worker, max(epoch_us(ts))::BIGINT AS last_us, count(DISTINCT floor(epoch_us(ts) / 5000000)) AS beats FROM events GROUP BY 1")
def st12_heartbeats(t: Tables) -> DataFrame:
    """The last sign of each worker, and how many intervals of five seconds had one."""
    made = events.heartbeats(t.events.select(col("user_id").alias("worker"), "ts"), 5)
    return made.select("worker", F.unix_micros(col("ts").cast("timestamp")).alias("last_us"), "beats")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e) SELECT user_id AS worker, min(epoch_us(ts))::BIGINT AS first_us, count(*) AS n FROM n GROUP BY user_id, b""")
def st13_work_batches(t: Tables) -> DataFrame:
    """Work put together until nothing has come for an hour."""
    made = events.work_batches(t.events.select(col("user_id").alias("worker"), col("ts").cast("timestamp").alias("ts")), "1 hour")
    return made.select("worker", F.unix_micros("first").alias("first_us"), "n")


@query("SELECT conv_id, turn, 'update' AS root, 2 AS depth FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'update', 4 FROM conversations WHERE turn % 2 = 1")
def doc_nodes_depth(t: Tables) -> DataFrame:
    """The depth of trees, from their elements."""
    line = F.replace(T.escaped(col("text")), F.lit("\n"), F.lit(" "))
    xml = F.when(col("turn") % 2 == 0, F.concat(F.lit("<p><b>"), line, F.lit("</b></p>"))).otherwise(F.concat(F.lit("<ul><li>x<ol><li>"), line, F.lit("</li></ol></li></ul>")))
    rows = B.nodes(t.conversations.select("conv_id", "turn", T.update(xml).alias("xml")), ["conv_id", "turn"])
    return rows.groupBy("conv_id", "turn").agg(F.max(F.when(col("depth") == 0, col("tag"))).alias("root"), F.max("depth").alias("depth"))


@query(f"""WITH RECURSIVE b AS ({PLACED}), kept AS (SELECT conv_id, turn AS old, (turn * 5 + conv_id) % 7 AS new FROM b WHERE turn % 4 <> 3),
    paths AS (SELECT conv_id, old, new, 1 AS n FROM kept UNION SELECT k.conv_id, k.old, k.new, n + 1 FROM paths p JOIN kept k ON k.conv_id = p.conv_id AND k.old > p.old AND k.new > p.new),
    longest AS (SELECT conv_id, max(n) AS n FROM paths GROUP BY 1)
    SELECT b.conv_id::VARCHAR AS document_id, (count(*) FILTER (WHERE turn % 4 <> 3) - coalesce(any_value(n), 0))::BIGINT AS n_moves, count(*) FILTER (WHERE turn % 4 = 3)::BIGINT AS n_deletes, count(*) FILTER (WHERE turn % 3 = 0)::BIGINT AS n_inserts
    FROM b LEFT JOIN longest ON longest.conv_id = b.conv_id GROUP BY b.conv_id""")
def sk11_fewest_moves(t: Tables) -> DataFrame:
    """Lists of turns put in another order, with some gone and some new ones: moves, deletes and inserts."""
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), "conv_id", "turn")
    ids = lambda c: F.transform(F.array_sort(c), lambda x: x["id"])
    place = ((col("turn") * 5 + col("conv_id")) % 7).alias("place")
    named = lambda letter: F.concat(F.lit(letter), "turn").alias("id")
    old = ids(F.collect_list(F.struct(col("turn").alias("place"), named("b"))))
    moved = F.collect_list(F.when(col("turn") % 4 != 3, F.struct(place, named("b"))))
    fresh = F.collect_list(F.when(col("turn") % 3 == 0, F.struct(place, named("n"))))
    lists = rows.groupBy("document_id").agg(old.alias("old"), ids(F.concat(moved, fresh)).alias("new"))
    count = lambda step, name: F.count_if(col("step") == step).alias(name)
    found = events.list_steps(lists).groupBy("document_id").agg(count("move", "n_moves"), count("delete", "n_deletes"), count("insert", "n_inserts"))
    names = ("n_moves", "n_deletes", "n_inserts")
    return lists.select("document_id").join(found, "document_id", "left").select("document_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


@query("SELECT conv_id, turn, sha256(encode(text) || from_hex(repeat('00', ((48 - strlen(text) % 48) % 48 + CASE WHEN text = '' THEN 48 ELSE 0 END)::INT))) AS pixels, greatest(ceil(strlen(text) / 48), 1)::INT AS height FROM conversations")
def sc5_pixels(t: Tables) -> DataFrame:
    """Texts as pixels of images, under each of the filters in turn: decoded, written anew and decoded again they have the same pixels."""

    @F.pandas_udf("binary")
    def drawn(text: pd.Series, kind: pd.Series) -> pd.Series:
        rows = [t.encode() for t in text]
        rows = [np.frombuffer(r + bytes(-len(r) % 48 or (0 if r else 48)), np.uint8).reshape(-1, 16, 3) for r in rows]
        return pd.Series([png.encode(r, int(k)) for r, k in zip(rows, kind, strict=True)])

    @F.pandas_udf("binary")
    def pixels(content: pd.Series) -> pd.Series:
        return content.map(lambda c: png.decode(c).tobytes())

    images = t.conversations.select(F.struct("conv_id", "turn").alias("image_id"), drawn("text", col("turn") % 5).alias("content"))
    found = files.normalized_images(images)
    return found.select("image_id.conv_id", "image_id.turn", F.sha2(pixels("png"), 256).alias("pixels"), "height")


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[ \t]*[\r\n]+[ \t]*', '', 'g'), '\t', '', 'g') AS structural, length(regexp_replace(text, '\s+', '', 'g'))::INT AS nonspace, least(8192, 15872 - length(text))::BIGINT AS budget,
    '<p>' || replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), chr(10), '<br/>') || '</p>' AS paragraph, sha256(text) AS digest, least(30, power(2, turn))::BIGINT AS wait FROM conversations""")
def sql_inlined_functions(t: Tables) -> DataFrame:
    """Functions of SQL that are expressions: the plan has no Python in it."""
    register.register_inlined(t.spark)
    t.conversations.createOrReplaceTempView("docflow_inlined")
    return t.spark.sql("SELECT conv_id, turn, doc_structural(text) AS structural, doc_nonspace(text) AS nonspace, doc_output_budget(length(text)) AS budget, doc_paragraph(text) AS paragraph, doc_sha256(text) AS digest, doc_backoff(CAST(turn AS INT)) AS wait FROM docflow_inlined")
