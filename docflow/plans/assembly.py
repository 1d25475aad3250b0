"""Queries of drafts, overlap and requests: documents assembled from recorded replies, with their SQL.

A conversation is a document, each of its turns an image, and the turn's text what is recognised of it. The replies are
made from the text so that what must come of them can be said in SQL.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import tree
from ..operators import blocks, drafts, overlap, requests
from ..sources.shared import scratch
from ..streaming import assembly as stream
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col
LINE = "replace(text, chr(10), ' ')"
PLACED = f"SELECT *, {LINE} AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations"


def placed(t: Tables) -> DataFrame:
    """Turns with their texts on one line and their places from 0."""
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), "conv_id", "turn", "role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line")).withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)


def value(text: Column, xml: Column | None = None) -> Column:
    """A block's value as a reply has it."""
    made = F.concat(F.lit("<p>"), T.escaped(text), F.lit("</p>")) if xml is None else xml
    return F.struct(made.alias("xml"), text.alias("text"), F.array().cast("array<string>").alias("ocr_refs"))


def reply(*blocks: Column, **more: Column) -> Column:
    """A complete reply of some blocks."""
    fields = [F.lit("generate").alias("action"), F.array(*blocks).alias("blocks"), *(c.alias(k) for k, c in more.items())]
    return F.struct(F.to_json(F.struct(*fields)).alias("content"), F.lit("stop").alias("finish_reason"))


def images(rows: DataFrame, *calls: Column, content: str = "line") -> DataFrame:
    return rows.select("document_id", col("place").alias("image_ord"), F.concat(F.lit("i"), "place").alias("image_id"), col(content).alias("content"), F.array(*calls).alias("calls"))


BROKEN = "<p><q/></p>"


@query(f"""SELECT conv_id::VARCHAR AS document_id, (place // 2)::INT AS ord, string_agg(line, ' ' ORDER BY place) AS text, (count(*) - 1)::INT AS version, 'ok' AS status FROM ({PLACED}) GROUP BY 1, 2""")
def dm15_continued_tails(t: Tables) -> DataFrame:
    """Every second image continues the block before, with all of its text in front."""
    rows = placed(t).withColumn("before", F.lag("line").over(W.partitionBy("conv_id").orderBy("turn")))
    whole = F.concat("before", F.lit(" "), "line")
    goes_on = F.struct(F.to_json(F.struct(F.lit("generate").alias("action"), F.array().cast("array<string>").alias("blocks"), value(whole).alias("tail"))).alias("content"), F.lit("stop").alias("finish_reason"))
    made = drafts.assemble(images(rows, F.when(col("place") % 2 == 1, goes_on).otherwise(reply(value(col("line"))))))
    return made.select("document_id", "ord", "text", "version", "status")


@query(f"""SELECT conv_id::VARCHAR AS document_id, place::INT AS ord, CASE WHEN place % 2 = 0 THEN line END AS text, 0 AS version, CASE WHEN place % 2 = 0 THEN 'ok' ELSE 'unresolved' END AS status FROM ({PLACED})""")
def dm15_lost_tails(t: Tables) -> DataFrame:
    """Every second image would continue the block before without its text: that block stays, and a hole follows."""
    rows = placed(t)
    lost = F.struct(F.to_json(F.struct(F.lit("generate").alias("action"), F.array().cast("array<string>").alias("blocks"), value(F.concat(F.lit("#"), "line")).alias("tail"))).alias("content"), F.lit("stop").alias("finish_reason"))
    made = drafts.assemble(images(rows, F.when(col("place") % 2 == 1, lost).otherwise(reply(value(col("line"))))))
    return made.select("document_id", "ord", "text", "version", "status")


@query(f"""SELECT conv_id::VARCHAR AS document_id, 'i' || place AS image_id, CASE WHEN turn % 2 = 0 THEN 5 ELSE 2 END AS n_repairs, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS n_applied FROM ({PLACED})""")
def dm16_repair_budget(t: Tables) -> DataFrame:
    """Repairs that never succeed end after five; others end with the one that does."""
    rows = placed(t)
    bad = reply(value(F.lit("other")))
    good = F.when(col("turn") % 2 == 1, reply(value(col("line")))).otherwise(bad)
    made = drafts.assembly_log(images(rows, reply(value(col("line"), F.lit(BROKEN))), bad, good, *[bad] * 5))
    return made.select("document_id", "image_id", "n_repairs", "n_applied")


@query(f"""SELECT conv_id::VARCHAR AS document_id, 'i' || place AS image_id, CASE turn % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'fallback' WHEN 2 THEN 'ok' ELSE 'fallback' END AS status, CASE turn % 4 WHEN 2 THEN line || chr(10) ELSE line END AS text FROM ({PLACED})""")
def dm17_preserved_content(t: Tables) -> DataFrame:
    """Repairs that keep the text, change a letter, keep code, or change its white space; those refused leave the text that was read."""
    rows, rest = placed(t), col("turn") % 4
    code = lambda c: F.concat(F.lit("<pre><code>"), T.escaped(c), F.lit("</code></pre>"))
    line = col("line")
    first = F.when(rest == 2, reply(value(F.concat(line, F.lit("\n")), F.concat(F.lit("<blockquote>"), code(F.concat(line, F.lit("\n"))), F.lit("</blockquote>"))))).when(rest == 3, reply(value(line, F.concat(F.lit("<blockquote>"), code(line), F.lit("</blockquote>"))))).otherwise(reply(value(line, F.lit(BROKEN))))
    changed = F.concat(F.lit("\t"), line)
    second = F.when(rest == 0, reply(value(line))).when(rest == 1, reply(value(F.concat(line, F.lit("x"))))).when(rest == 2, reply(value(F.concat(line, F.lit("\n")), code(F.concat(line, F.lit("\n")))))).otherwise(reply(value(changed, code(changed))))
    return drafts.assemble(images(rows, first, second)).select("document_id", "image_id", "status", "text")


@query(f"""SELECT conv_id::VARCHAR AS document_id, (2 * (row_number() OVER (PARTITION BY conv_id, half ORDER BY turn) - 1) + half)::INT AS ord, CASE half WHEN 0 THEN substr(line, 1, 10) ELSE substr(line, 11) END AS text, (1 - half)::INT AS version, 'ok' AS status
    FROM ({PLACED}), (VALUES (0), (1)) v(half) WHERE length(line) > 12""")
def dm18_splices(t: Tables) -> DataFrame:
    """Each failed block repaired into two, the first under its id with the next version."""
    rows = placed(t).filter("length(line) > 12").withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    made = drafts.assemble(images(rows, reply(value(col("line"), F.lit(BROKEN))), reply(value(F.substring("line", 1, 10)), value(F.expr("substr(line, 11)")))))
    return made.select("document_id", "ord", "text", "version", "status")


@query(f"""SELECT conv_id::VARCHAR AS document_id, place::INT AS ord, CASE turn % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'vlm_text' END AS fallback_source, CASE turn % 3 WHEN 0 THEN rtrim(text, chr(10)) WHEN 1 THEN line || '!' ELSE NULL END AS text, CASE turn % 3 WHEN 2 THEN 'unresolved' ELSE 'fallback' END AS status FROM ({PLACED})""")
def dm19_fallbacks(t: Tables) -> DataFrame:
    """Failed blocks that name all lines of their image, none, or have no text either."""
    rest = col("turn") % 3
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), "turn", "text", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("place"))
    lines = F.split("text", "\n")
    refs = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", F.concat(F.lit("i"), col("place"), F.lit(":ocr:"), i))), lambda x: x.isNotNull())
    text = F.when(rest == 2, F.lit(None).cast("string")).otherwise(F.concat("line", F.lit("!")))
    block = F.struct(F.lit(BROKEN).alias("xml"), text.alias("text"), F.when(rest == 0, refs).otherwise(F.array().cast("array<string>")).alias("ocr_refs"))
    return drafts.assemble(images(rows, reply(block), content="text")).select("document_id", "ord", "fallback_source", "text", "status")


@query(f"""SELECT conv_id::VARCHAR AS document_id, place::INT AS ord, 'i' || place AS image_id, CASE WHEN role = 'user' THEN 'ok' ELSE 'fallback' END AS status, CASE WHEN role <> 'user' THEN 'ocr' END AS fallback_source, CASE WHEN role = 'user' THEN line ELSE rtrim(text, chr(10)) END AS text FROM ({PLACED})""")
def dm20_assemble(t: Tables) -> DataFrame:
    """Documents assembled from replies, and from the recognised text where a reply was cut off."""
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), "role", "text", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("place"))
    call = reply(value(col("line")))
    cut = F.struct(F.lit('{"action": "gen').alias("content"), F.lit("length").alias("finish_reason"))
    return drafts.assemble(images(rows, F.when(col("role") == "user", call).otherwise(cut), content="text")).select("document_id", "ord", "image_id", "status", "fallback_source", "text")


@query(f"""WITH p AS (SELECT *, min(place) FILTER (WHERE turn % 3 = 0) OVER (PARTITION BY conv_id) AS first FROM ({PLACED}))
    SELECT conv_id::VARCHAR AS document_id, place::INT AS ord, CASE WHEN turn % 3 = 2 THEN 'fallback' ELSE 'ok' END AS status, CASE WHEN turn % 3 = 2 THEN rtrim(text, chr(10)) ELSE line END AS text, (turn % 3 = 0)::INT AS repair_attempts,
        (place = first)::BIGINT AS n_asked, CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_received FROM p""")
def st14_streamed_assembly(t: Tables) -> DataFrame:
    """Documents assembled by a stream that stops after the first reply of each image and goes on with the rest: every third reply is repaired by a second one, every
    third is cut off. Only calls whose reply isn't there are asked for, once."""
    rows, rest = placed(t).join(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"]), col("turn") % 3
    good = reply(value(col("line")))
    cut = F.struct(F.lit("[").alias("content"), F.lit("length").alias("finish_reason"))
    first = F.when(rest == 0, reply(value(col("line"), F.lit(BROKEN)))).when(rest == 1, good).otherwise(cut)
    calls = F.when(rest == 0, F.array(first, good)).otherwise(F.array(first))
    recorded = rows.select("document_id", col("place").alias("image_ord"), F.concat(F.lit("i"), "place").alias("image_id"), col("text").alias("content"), calls.alias("calls"))
    found = stream.as_events(recorded)
    path = scratch(t.spark, "assembly")
    for part in ("step = 0 AND kind <> 'close'", "step > 0 OR kind = 'close'"):
        found.filter(part).drop("step").write.mode("append").parquet(f"{path}/events")
        stream.answering(t.spark, f"{path}/events", path).awaitTermination()
    given = stream.answers(t.spark, path)
    calls_made = given.groupBy("document_id", F.concat(F.lit("i"), "image_ord").alias("image_id")).agg(F.count_if(col("kind") == "ask").alias("n_asked"), F.count_if(col("kind") == "received").alias("n_received"))
    return stream.committed(given).join(calls_made, ["document_id", "image_id"]).select("document_id", "ord", "status", "text", "repair_attempts", "n_asked", "n_received")


def claiming(t: Tables, *kinds: str) -> DataFrame:
    """Two replies for each conversation and kind: the second repeats the first's heading and text, adds a block, and claims so."""

    @F.pandas_udf("array<struct<content:string,finish_reason:string>>")
    def made(lines: pd.Series, named: pd.Series) -> pd.Series:
        out = []
        for line, kind in zip(lines, named, strict=True):
            block = lambda text, tag="p": {"xml": f"<{tag}>{tree.escape(text)}</{tag}>", "text": text, "ocr_refs": []}
            old = [block("Head", "h2"), block(line)]
            refs = [overlap.history_ref({"version": 0, "image_id": "i0"} | v, i) for i, v in enumerate(old)]
            refs = {"reversed": refs[::-1], "unknown": [*refs[:1], "h1v0:none"], "twice": refs[:1] * 2}.get(kind, refs)
            claim = {"relation": overlap.RELATION, "candidate_prefix_count": -1 if kind == "negative" else 2, "history_refs": refs} | ({"more": 1} if kind == "extra" else {})
            new = [block("Head", "h2"), block(line + "." * (kind == "changed")), block("New")]
            out.append([(json.dumps({"action": "generate", "blocks": blocks} | more), "stop") for blocks, more in ((old, {}), (new, {"overlap_claim": claim}))])
        return pd.Series([[{"content": c, "finish_reason": f} for c, f in calls] for calls in out])

    rows = t.conversations.filter("turn = 1").select(col("conv_id").cast("string").alias("document_id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    each = rows.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return each.select("document_id", "kind", made("line", "kind").alias("calls"))


def two_images(rows: DataFrame) -> DataFrame:
    return rows.select("document_id", F.posexplode("calls").alias("place", "call"), F.lit("").alias("line")).select("document_id", "place", "line", "call")


CLAIMED = r"""SELECT conv_id::VARCHAR AS document_id, length(regexp_replace(text, '\s+', '', 'g')) >= 40 AS long FROM conversations WHERE turn = 1"""


@query(f"SELECT document_id, CASE WHEN long THEN 2 ELSE 0 END AS n_omitted, CASE WHEN long THEN 1 ELSE 3 END AS n_committed, CASE WHEN long THEN [] ELSE ['OVERLAP_EVIDENCE_TOO_SHORT'] END AS warnings FROM ({CLAIMED})")
def dm14_proven_overlap(t: Tables) -> DataFrame:
    """Images that claim to repeat two blocks, and do."""
    log = drafts.assembly_log(images(two_images(claiming(t, "good")), col("call")))
    return log.filter("image_id = 'i1'").select("document_id", "n_omitted", "n_committed", "warnings")


@query(f"SELECT document_id, 0 AS n_omitted, 3 AS n_committed, [CASE WHEN long THEN 'OVERLAP_CONTENT_CONFLICT' ELSE 'OVERLAP_EVIDENCE_TOO_SHORT' END] AS warnings FROM ({CLAIMED})")
def dm13_changed_overlap(t: Tables) -> DataFrame:
    """The same claims where one sign differs."""
    log = drafts.assembly_log(images(two_images(claiming(t, "changed")), col("call")))
    return log.filter("image_id = 'i1'").select("document_id", "n_omitted", "n_committed", "warnings")


@query("SELECT conv_id::VARCHAR AS document_id, code AS kind, 0 AS n_omitted, 3 AS n_committed, [CASE code WHEN 'reversed' THEN 'OVERLAP_HISTORY_NOT_CONTIGUOUS' WHEN 'unknown' THEN 'OVERLAP_HISTORY_INVALID' ELSE 'OVERLAP_CLAIM_INVALID' END] AS warnings FROM conversations, (VALUES ('reversed'), ('unknown'), ('extra'), ('negative'), ('twice')) v(code) WHERE turn = 1")
def dm11_refused_claims(t: Tables) -> DataFrame:
    """Claims that are malformed or refer to what wasn't sent so: nothing is lost, a warning says why."""
    claims = claiming(t, "reversed", "unknown", "extra", "negative", "twice").withColumn("document_id", F.concat("kind", F.lit(":"), "document_id"))  # a document for each kind
    log = drafts.assembly_log(images(two_images(claims), col("call"))).filter("image_id = 'i1'")
    kind, document = F.substring_index("document_id", ":", 1), F.expr("substr(document_id, instr(document_id, ':') + 1)")
    return log.select(document.alias("document_id"), kind.alias("kind"), "n_omitted", "n_committed", "warnings")


@query(f"""SELECT conv_id::VARCHAR AS document_id, count(*)::INT AS n_rounds, true AS valid, '<document xmlns="urn:docflow:document:1" schema-version="0.1">' || string_agg('<p>' || place || '</p>', '' ORDER BY place) || '</document>' AS xml FROM ({PLACED}) GROUP BY 1""")
def dm25_replayed_rounds(t: Tables) -> DataFrame:
    """Chains of updates, each of which repeats the tail and adds a block."""
    p = lambda c: F.concat(F.lit("<p>"), c.cast("string"), F.lit("</p>"))
    body = F.when(col("place") == 0, p(col("place"))).otherwise(F.concat(p(col("place") - 1), p(col("place"))))
    return drafts.replay_rounds(placed(t).select("document_id", col("place").alias("round_index"), F.lit(None).cast("string").alias("base_sha256"), T.update(body).alias("update_xml")))


@query(f"""SELECT conv_id::VARCHAR AS document_id, CASE WHEN conv_id % 2 = 0 THEN least(count(*), 1) ELSE 0 END::INT AS n_rounds, CASE WHEN conv_id % 2 = 0 THEN count(*) = 1 ELSE false END AS valid FROM ({PLACED}) GROUP BY conv_id""")
def dm25_broken_chains(t: Tables) -> DataFrame:
    """Chains that name another document from the first or the second round on, or bring an invalid update."""
    empty = T.sha256(T.update(F.lit(""), "document"))
    base = F.when((col("place") == 0) & (col("conv_id") % 2 == 0), empty).otherwise("other")
    return drafts.replay_rounds(placed(t).select("document_id", col("place").alias("round_index"), base.alias("base_sha256"), T.update(F.lit("<p>x</p>")).alias("update_xml"))).select("document_id", "n_rounds", "valid")


CONTEXT = """WITH b AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    target AS (SELECT conv_id, n, n - 1 AS o FROM b WHERE ord = n - 1)"""


@query(f"""{CONTEXT}
    SELECT t.conv_id::VARCHAR AS document_id,
        coalesce((SELECT list(ord::INT ORDER BY ord) FROM b WHERE b.conv_id = t.conv_id AND role = 'user'), []) AS targets,
        coalesce((SELECT list(ord::INT ORDER BY ord) FROM b WHERE b.conv_id = t.conv_id AND role <> 'user' AND EXISTS (SELECT 1 FROM b x WHERE x.conv_id = b.conv_id AND x.role = 'user' AND abs(x.ord - b.ord) = 1)), []) AS neighbours,
        coalesce((SELECT list(ord::INT ORDER BY ord) FROM b WHERE b.conv_id = t.conv_id AND ord >= t.n - 3 AND ord < t.n - 1), []) AS recent, t.o::INT AS tail, t.n::BIGINT AS history_blocks FROM target t""")
def dm28_request_context(t: Tables) -> DataFrame:
    """What a request is made of: the blocks to repair, their neighbours, the last history and its tail."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), place.alias("ord"), "role", "text")
    history = rows.select("document_id", "ord", F.lit(0).alias("version"), F.concat(F.lit("b"), "ord").alias("id"), F.concat(F.lit("<p>"), T.escaped(col("text")), F.lit("</p>")).alias("xml"), "text", F.lit("ok").alias("status"))
    draft = history.join(rows.select("document_id", "ord", (col("role") == "user").alias("target")), ["document_id", "ord"])
    made = requests.contexts(draft, history)
    ords = lambda c: F.transform(c, lambda x: x["ord"])
    return made.select("document_id", ords("targets").alias("targets"), ords("neighbours").alias("neighbours"), ords("recent").alias("recent"), col("tail.ord").alias("tail"), "history_blocks")


@query("SELECT conv_id::VARCHAR AS document_id, count(*) AS n, sum((length(text) > 0)::INT)::BIGINT AS shown FROM conversations GROUP BY 1")
def pf2_history_view(t: Tables) -> DataFrame:
    """Committed blocks as a request shows them, with the reference by which a claim may name them."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), place.alias("ord"), F.lit(3).alias("version"), F.lit("i").alias("image_id"), "text", F.lit("ok").alias("status"), F.concat(F.lit("<p>"), T.escaped(col("text")), F.lit("</p>")).alias("xml"))
    view = overlap.history_views(rows)
    return view.groupBy("document_id").agg(F.count_if(col("history_ref").rlike("^h[0-9]+v3:[0-9a-f]{64}$")).alias("n"), F.count_if(F.length("text") > 0).alias("shown"))


@query(f"""SELECT conv_id::VARCHAR AS document_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord, turn::INT AS source FROM conversations WHERE turn % 3 <> 1 OR false""")
def pf4_visible_blocks(t: Tables) -> DataFrame:
    """Candidates that a reader may see: those that keep the document valid, one after another; here every third one is a title that
    comes too late."""
    xml = F.when(col("turn") % 3 == 1, "<title>t</title>").otherwise(F.concat(F.lit("<p>"), T.escaped(col("text")), F.lit("</p>")))
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("source"), xml.alias("xml"))
    return blocks.visible(rows.withColumnRenamed("source", "ord")).select("document_id", col("shown").alias("ord"), col("ord").alias("source"))


@query(r"""WITH b AS (SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, regexp_replace(text, '\s+', '', 'g') AS s, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
    SELECT document_id, ord, 1.0::DOUBLE AS score FROM b WHERE ord < last AND length(s) >= 12""")
def j6_similarity(t: Tables) -> DataFrame:
    """Blocks against a query that holds them whole; those with fewer characters than a run needs have none."""
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), "text")
    last = F.max("ord").over(W.partitionBy("document_id"))
    rows = rows.withColumn("last", last)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    asked = rows.groupBy("document_id").agg(whole.alias("query")).withColumn("query_id", F.lit("q"))
    return overlap.similarities(rows.filter("ord < last").select("document_id", "ord", "text"), asked).select("document_id", "ord", F.round("score", 6).alias("score"))


@query(r"""WITH b AS (SELECT conv_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM conversations),
    k AS (SELECT document_id, count(*) FILTER (WHERE n >= 12) AS good, count(*) AS k FROM b GROUP BY 1)
    SELECT document_id, (k - least(k, 2))::INT AS first_ord, least(k, 2)::INT AS n_blocks, least(k, 2)::DOUBLE AS score FROM k WHERE good = k""")
def dm10_retrieved_window(t: Tables) -> DataFrame:
    """The window of two blocks that a query resembles most; the query holds all of them, and ties go to the later start."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), place.alias("ord"), F.lit("i").alias("image_id"), F.lit("ok").alias("status"), "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    good = F.bool_and(F.length(T.stripped(col("text"))) >= 12)
    asked = rows.groupBy("document_id").agg(whole.alias("text"), good.alias("good")).filter("good").select("document_id", F.lit("q").alias("query_id"), "text")
    return overlap.retrieve(rows, asked, limit=2).select("document_id", "first_ord", "n_blocks", "score")
