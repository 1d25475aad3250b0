"""Queries of text, grammar and candidate functions over conversations and documents, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align, register, tree
from ..functions import text as T
from ..operators import blocks as B
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col
ESCAPED = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), col("role").alias("image_id"), "text")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '\s+', '', 'g')) AS digest, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS n FROM documents")
def sf2_stripped(t: Tables) -> DataFrame:
    """Texts without white space, and how long they are."""
    return t.documents.select("doc_id", T.sha256(T.stripped(col("text"))).alias("digest"), T.nonspace_count(col("text")).cast("long").alias("n"))


@query(r"SELECT conv_id, turn, sha256(replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')) AS digest FROM conversations")
def sf3_retrieval_text(t: Tables) -> DataFrame:
    """Texts as retrieval compares them."""
    register.register(t.spark)
    return t.conversations.select("conv_id", "turn", T.sha256(F.expr("doc_casefold(text)")).alias("digest"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN rtrim(text, chr(10)) WHEN 1 THEN role || chr(9) || replace(text, chr(10), ' ') || chr(10) || 'x' || chr(9) || 'y' ELSE role || chr(10) || replace(text, chr(10), ' ') END AS plain FROM conversations")
def sf4_plain_text(t: Tables) -> DataFrame:
    """Readable text of paragraphs, tables and lists."""
    line = T.escaped(F.replace("text", F.lit("\n"), F.lit(" ")))
    table = F.concat(F.lit("<table><tbody><tr><td>"), "role", F.lit("</td><td>"), line, F.lit("</td></tr><tr><td>x</td><td>y</td></tr></tbody></table>"))
    items = F.concat(F.lit("<ul><li>"), "role", F.lit("</li><li>"), line, F.lit("</li></ul>"))
    xml = F.when(col("turn") % 3 == 0, T.paragraph(col("text"))).when(col("turn") % 3 == 1, table).otherwise(items)
    register.register(t.spark)
    return t.conversations.select("conv_id", "turn", xml.alias("xml")).select("conv_id", "turn", F.expr("doc_plain_text(xml)").alias("plain"))


@query("SELECT conv_id, turn, replace(text, chr(10), '') AS content FROM conversations")
def sf5_xml_text(t: Tables) -> DataFrame:
    """All character data of a block."""
    rows = B.nodes(t.conversations.select("conv_id", "turn", T.update(F.concat(F.lit("<p><b>"), F.replace(T.escaped(col("text")), F.lit("\n"), F.lit("</b><b>")), F.lit("</b></p>"))).alias("xml")), ["conv_id", "turn"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "text"))), lambda x: x["text"])
    return rows.groupBy("conv_id", "turn").agg(F.array_join(parts, "").alias("content"))


@query(f"SELECT conv_id, turn, '<p>' || replace({ESCAPED}, chr(10), '<br/>') || '</p>' AS xml, true AS valid FROM conversations")
def sf7_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of plain text, which are valid again."""
    rows = t.conversations.select("conv_id", "turn", T.paragraph(col("text")).alias("xml"))
    return B.validated(rows.withColumn("all", T.update(col("xml"))), "all").select("conv_id", "turn", "xml", "check.valid")


MARKS = "CASE conv_id % 5 WHEN 0 THEN '<|end|>' WHEN 1 THEN '</think>' WHEN 2 THEN '~~~' WHEN 3 THEN '<thinker>' ELSE '' END"


@query(f"SELECT conv_id, turn, regexp_matches(x, '<\\|[^|]*\\|>|</?(think|tool_call|tool_response)\\b|```|~~~') AS control, regexp_matches(x, '<(pre|code)[\\s/>]') AS code FROM (SELECT conv_id, turn, text || {MARKS} || CASE turn % 2 WHEN 0 THEN '<code >' ELSE '<codec>' END AS x FROM conversations)")
def sf8_markup(t: Tables) -> DataFrame:
    """Marks of chats, and code elements, in texts to which some were added."""
    rest = col("conv_id") % 5
    marks = F.when(rest == 0, "<|end|>").when(rest == 1, "</think>").when(rest == 2, "~~~").when(rest == 3, "<thinker>").otherwise("")
    x = F.concat("text", marks, F.when(col("turn") % 2 == 0, "<code >").otherwise("<codec>"))
    return t.conversations.select("conv_id", "turn", T.control_markup(x).alias("control"), T.code_markup(x).alias("code"))


@query("SELECT conv_id, turn, [x || chr(10) for x in string_split(text, chr(10))] AS pieces FROM conversations")
def sf9_code_pieces(t: Tables) -> DataFrame:
    """The protected code of a block: a piece for each of its code elements."""
    from ..operators.drafts import code_pieces

    @F.pandas_udf("array<string>")
    def pieces(xml: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([code_pieces({"xml": x, "text": t}) for x, t in zip(xml, text, strict=True)])

    xml = F.concat(F.lit("<pre><code>"), F.replace(T.escaped(col("text")), F.lit("\n"), F.lit("\n</code></pre><pre><code>")), F.lit("\n</code></pre>"))
    return t.conversations.select("conv_id", "turn", pieces(xml, F.concat("text", F.lit("\n"))).alias("pieces"))


@query("""SELECT o_orderkey, sha256('{"id":' || o_orderkey || ',"refs":["' || o_orderstatus || '"],"text":"' || o_orderpriority || '"}') AS digest FROM orders""")
def sf10_canonical_digest(t: Tables) -> DataFrame:
    """Digests of canonical JSON: keys sorted, nothing between."""

    @F.pandas_udf("string")
    def digests(i: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([B.digest({"text": c, "refs": [b], "id": int(a)}) for a, b, c in zip(i, s, p, strict=True)])

    return t.orders.select("o_orderkey", digests("o_orderkey", "o_orderstatus", "o_orderpriority").alias("digest"))


@query("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","tags":["é","' || n_regionkey || '"]}' AS json FROM nation""")
def sf12_compact_json(t: Tables) -> DataFrame:
    """Compact JSON with other scripts as they are."""
    return t.nation.select("n_nationkey", F.to_json(F.struct(col("n_nationkey").alias("id"), col("n_name").alias("name"), F.array(F.lit("é"), col("n_regionkey").cast("string")).alias("tags"))).alias("json"))


@query("SELECT n_nationkey, repeat(n_name, n_nationkey + 1) AS payload FROM nation")
def sf17_exact_payload(t: Tables) -> DataFrame:
    """Repetitions with exactly as many tokens as asked for; here a token is a character."""

    @F.pandas_udf("string")
    def payload(unit: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([align.exact_repeat(u, len, int(n)) for u, n in zip(unit, tokens, strict=True)])

    return t.nation.select("n_nationkey", payload("n_name", F.length("n_name") * (col("n_nationkey") + 1)).alias("payload"))


@query("SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso FROM events")
def sf18_times(t: Tables) -> DataFrame:
    """Times as milliseconds and in ISO form."""
    return t.events.select("event_id", T.epoch_ms(col("ts")).alias("ms"), T.iso_time(col("ts")).alias("iso"))


@query("SELECT conv_id::VARCHAR AS document_id, string_agg((place + 1) || '. ' || role || chr(10) || '  • ' || length(text), chr(10) ORDER BY turn) || chr(10) || chr(10) || '────────' || chr(10) || chr(10) || min(conv_id) || chr(9) || 'end' AS plain FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) GROUP BY 1")
def sf20_plain_render(t: Tables) -> DataFrame:
    """Nested lists, a rule and a table as plain text."""
    item = F.concat(F.lit("<li>"), "role", F.lit("<ul><li>"), F.length("text").cast("string"), F.lit("</li></ul></li>"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), "")
    end = F.concat(F.lit("</ol><hr/><table><tbody><tr><td>"), col("conv_id").cast("string"), F.lit("</td><td>end</td></tr></tbody></table>"))
    docs = t.conversations.groupBy("conv_id").agg(items.alias("items")).select(col("conv_id").cast("string").alias("document_id"), T.update(F.concat(F.lit("<ol>"), "items", end), "document").alias("xml"))
    return B.rendered(docs).select("document_id", "plain")


SHAPES = ["<p>{}</p>", "<p><b>{}</b></q>", "<!DOCTYPE p><p>{}</p>", "<quote>{}</quote>", "<ul>{}<li>x</li></ul>", "<p>{}</p><p> </p>", "<p><span>{}</span></p>", "<table><tbody><tr><td rowspan='2'>{}</td></tr></tbody></table>", "<hr/><pre><code>{}</code></pre>"]
STAGES = [None, "syntax", "security", "schema", "schema", "semantic", "semantic", "semantic", None]
CODES = [None, "XML_SYNTAX", "DOCTYPE", "SCHEMA", "SCHEMA", "EMPTY_PARAGRAPH", "SPAN_COLOR_REQUIRED", "TABLE_SPAN_INVALID", None]
BLOCKS = [None, None, None, None, 0, 1, 0, 0, None]


def by_shape(values: list) -> str:
    """SQL that gives a value for each shape."""
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "CASE k " + " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"


def shaped(t: Tables) -> DataFrame:
    """Turns in one of the shapes, most of which break one rule."""
    k = (col("conv_id") * 4 + col("turn")) % len(SHAPES)
    text, inner = T.escaped(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        before, after = shape.split("{}")
        inner = F.when(k == i, F.concat(F.lit(before), text, F.lit(after))).otherwise(inner)
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), col("role").alias("image_id"), k.cast("int").alias("k"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), inner.alias("xml"))


SHAPED = f"SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, role, replace(text, chr(10), ' ') AS text, ((conv_id * 4 + turn) % {len(SHAPES)})::INT AS k FROM conversations"


@query(f"SELECT document_id, ord, {by_shape(STAGES)} IS NULL AS valid, {by_shape(STAGES)} AS stage, {by_shape(CODES)} AS code, {by_shape(BLOCKS)} AS block_index FROM ({SHAPED})")
def dm1_validate_fragments(t: Tables) -> DataFrame:
    """The first issue of fragments that are valid, or break a rule of each stage."""
    rows = shaped(t).withColumn("wrapped", F.when(col("k") == 2, F.concat(F.lit("<!DOCTYPE p>"), T.update(F.lit("<p>x</p>")))).otherwise(T.update(col("xml"))))
    return B.validated(rows, "wrapped").select("document_id", "ord", "check.valid", "check.stage", "check.code", "check.block_index")


@query(f"SELECT document_id, ord, sha256(role || '|' || ord)[1:32] AS id, CASE WHEN k = 0 THEN 'ok' ELSE 'pending' END AS status, CASE k WHEN 0 THEN [] WHEN 8 THEN ['ONE_ROOT'] WHEN 2 THEN ['XML_SYNTAX'] ELSE [{by_shape(CODES)}] END AS codes, CASE k WHEN 0 THEN [] WHEN 8 THEN [NULL] WHEN 7 THEN ['table'] WHEN 6 THEN ['style'] ELSE ['paragraph'] END AS topics FROM ({SHAPED}) WHERE k NOT IN (3, 4)")
def dm3_candidates(t: Tables) -> DataFrame:
    """Candidates with ids, statuses, error codes and the topics that advise on them."""
    rows = shaped(t).filter("k <> 3 AND k <> 4").withColumn("ocr_refs", F.array().cast("array<string>"))
    return B.candidates(rows).select("document_id", "ord", "id", "status", "codes", "topics")


@query("SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, CASE WHEN turn % 4 IN (0, 1) THEN 'ok' ELSE 'pending' END AS status, CASE turn % 4 WHEN 2 THEN ['LINK_TARGET_EMPTY'] WHEN 3 THEN ['SCHEMA'] ELSE [] END AS codes FROM conversations")
def dm6_links(t: Tables) -> DataFrame:
    """Links with a target, of another kind, blank, and without the attribute."""
    rest = col("turn") % 4
    attrs = F.when(rest == 0, " href='#x'").when(rest == 1, " href='mailto:a@b'").when(rest == 2, " href='  '").otherwise("")
    xml = F.concat(F.lit("<p><a"), attrs, F.lit(">"), F.replace(T.escaped(col("text")), F.lit("\n"), F.lit(" ")), F.lit("</a></p>"))
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), col("role").alias("image_id"), xml.alias("xml"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), F.array().cast("array<string>").alias("ocr_refs"))
    return B.candidates(rows).select("document_id", "ord", "status", "codes")


@query("""SELECT conv_id::VARCHAR AS document_id, CASE WHEN conv_id % 2 = 1 THEN place END::INT AS block_index, CASE WHEN conv_id % 2 = 0 THEN 'schema' ELSE 'semantic' END AS stage, CASE WHEN conv_id % 2 = 0 THEN 'SCHEMA' ELSE 'EMPTY_PARAGRAPH' END AS code
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations) WHERE place = k - 1 AND place > 0""")
def dm2_document_checks(t: Tables) -> DataFrame:
    """Documents whose last block is a late title, or blank."""
    last = F.max("ord").over(B.W.partitionBy("document_id"))
    rows = turns(t).withColumn("last", (col("ord") == last) & (col("ord") > F.min("ord").over(B.W.partitionBy("document_id"))))
    fault = F.when(col("document_id").cast("long") % 2 == 0, "<title>t</title>").otherwise("<p> </p>")
    return B.document_checks(rows.select("document_id", "ord", F.when(col("last"), fault).otherwise("<p>x</p>").alias("xml")))


RELATIONS = ["equal", "structural_whitespace_only", "xml_contains_more_text", "xml_is_text_substring", "xml_is_text_substring", "code_or_control_label_difference", "non_text_separator", "uncertain_difference"]


@query(f"SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, CASE (conv_id + turn) % 8 {' '.join(f'WHEN {i} THEN {chr(39)}{r}{chr(39)}' for i, r in enumerate(RELATIONS))} END AS relation, (conv_id + turn) % 8 = 4 AS hard_gate FROM conversations")
def dm5_relation(t: Tables) -> DataFrame:
    """How a turn's text relates to its block's, in cases of each kind."""
    k = (col("conv_id") + col("turn")) % 8
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    text = F.when(k == 1, F.concat(F.lit("\n"), line)).when(k == 3, F.concat(line, F.lit("-- ## **"))).when(k == 4, F.concat(line, F.lit("eight888"))).when(k == 5, F.concat(F.lit("<|im_start|>"), line)).when(k == 7, F.concat(F.lit("other: "), line, F.lit("."))).otherwise(line)
    inner = F.when(k == 2, F.concat(line, F.lit(" more"))).when(k == 7, F.concat(F.lit("0 "), line)).otherwise(line)
    xml = F.when(k == 6, "<hr/>").otherwise(F.concat(F.lit("<p>"), T.escaped(inner), F.lit("</p>")))
    rows = t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), xml.alias("xml"), text.alias("text"))
    return B.representation(rows).select("document_id", "ord", "relation", "hard_gate")


@query(r"""SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, n::BIGINT AS matched, CASE WHEN turn % 2 = 0 THEN n / (n + 3) ELSE 1 END::DOUBLE AS coverage, CASE WHEN turn % 2 = 0 THEN 1 ELSE n / (n + 3) END::DOUBLE AS support
    FROM (SELECT *, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM conversations)""")
def dm8_alignment_parts(t: Tables) -> DataFrame:
    """Texts aligned with themselves and three characters more, on one side or the other."""
    more = F.concat(F.lit("§ "), "text", F.lit(" §§"))
    even = col("ord") % 2 == 0
    return B.aligned(turns(t).select("document_id", "ord", F.when(even, more).otherwise(col("text")).alias("a"), F.when(even, col("text")).otherwise(more).alias("b")), "a", "b").select("document_id", "ord", "matched", "coverage", "support")


@query(r"""SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, round(CASE turn % 3 WHEN 2 THEN 0 ELSE n / (n + 6 * (turn % 3)) END, 6)::DOUBLE AS source_coverage, CASE turn % 3 WHEN 0 THEN [] WHEN 1 THEN CASE WHEN n / (n + 6) < 0.8 THEN ['CONTENT_MISMATCH'] ELSE [] END ELSE ['CONTENT_MISMATCH'] END AS errors,
    CASE turn % 3 WHEN 0 THEN false WHEN 1 THEN n / (n + 6) < 0.95 ELSE true END AS needs_review FROM (SELECT *, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM conversations)""")
def dm9_content_check(t: Tables) -> DataFrame:
    """Updates that have all of their source, lack six characters of it, or only repeat the tail."""

    @F.pandas_udf("source_coverage double, errors array<string>, needs_review boolean")
    def checked(update: pd.Series, tail: pd.Series, source: pd.Series) -> pd.DataFrame:
        found = align.content_checks(list(zip(update, tail, source, strict=True)))
        return pd.DataFrame([(f["source_coverage"], f["errors"], f["needs_review"]) for f in found], columns=["source_coverage", "errors", "needs_review"])

    rest = col("ord") % 3
    source = F.when(rest == 1, F.concat("text", F.lit("§§§§§§"))).when(rest == 2, "§§§§").otherwise(col("text"))
    tail = F.when(rest == 2, T.paragraph(col("text")))
    return turns(t).select("document_id", "ord", checked(T.update(T.paragraph(col("text"))), tail, source).alias("c")).select("document_id", "ord", "c.*")


@query("SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, CASE turn % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'pre' ELSE 'ul' END AS kind, 1::BIGINT AS n FROM conversations")
def dm12_profile(t: Tables) -> DataFrame:
    """The structures of blocks whose change would alter meaning."""

    @F.pandas_udf("array<string>")
    def kinds(xml: pd.Series) -> pd.Series:
        return pd.Series([[p[0] for p in tree.profile([tree.block_of(x)])] for x in xml])

    line = F.replace(T.escaped(col("text")), F.lit("\n"), F.lit(" "))
    rest = col("ord") % 3
    xml = F.when(rest == 0, F.concat(F.lit("<p><a href='x'>"), line, F.lit("</a><b>b</b></p>"))).when(rest == 1, F.concat(F.lit("<pre><code>"), line, F.lit("</code></pre>"))).otherwise(F.concat(F.lit("<ul><li>"), line, F.lit("</li></ul>")))
    found = turns(t).select("document_id", "ord", F.explode(kinds(xml)).alias("kind"))
    return found.groupBy("document_id", "ord", "kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS document_id, turn::INT AS ord, '<pre><code>' || " + ESCAPED.replace("(text,", "(text || chr(10),") + " || '</code></pre>' AS xml FROM conversations WHERE turn % 3 = 0")
def dm21_repair_options(t: Tables) -> DataFrame:
    """The repair that needs no judgement, for blocks that allow it; others have an attribute or more text."""
    rest = col("ord") % 3
    code = F.concat(F.lit("<pre><code>"), T.escaped(F.concat("text", F.lit("\n"))), F.lit("</code></pre>"))
    xml = F.concat(F.when(rest == 1, "<blockquote id='x'>").otherwise("<blockquote>"), code, F.when(rest == 2, "more").otherwise(""), F.lit("</blockquote>"))
    return B.options(turns(t).select("document_id", "ord", "image_id", xml.alias("xml"), F.concat("text", F.lit("\n")).alias("text"))).select("document_id", "ord", "xml")


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'NOT_OFFERED' WHEN 1 THEN 'STALE' ELSE CASE WHEN conv_id % 2 = 0 THEN 'SCOPE' END END AS code FROM conversations")
def dm22_choices(t: Tables) -> DataFrame:
    """Choices among offered repairs: of none that was offered, for a block that changed since, for another version, and good ones."""

    @F.pandas_udf("string")
    def code(conv: pd.Series, turn: pd.Series) -> pd.Series:
        out = []
        for c, k in zip(conv, turn, strict=True):
            offer = [{"option_id": f"o{k}", "target_versions": {"b": 1}, "blocks": []}]
            choice = {"option_id": "o" if k % 3 == 0 else f"o{k}", "target_versions": {"b": 2} if k % 3 == 2 and c % 2 == 0 else {"b": 1}}
            out.append(B.chosen_option(choice, offer, {"b": 2 if k % 3 == 1 else 1})[1])
        return pd.Series(out, dtype=object)

    return t.conversations.select("conv_id", "turn", code("conv_id", "turn").alias("code"))


@query("""SELECT conv_id::VARCHAR AS document_id, turn::VARCHAR AS image_id, o::INT AS ord, CASE o WHEN 0 THEN 'fallback' ELSE 'unresolved' END AS status, CASE o WHEN 0 THEN text END AS text
    FROM conversations, (VALUES (0), (1)) v(o) WHERE o = 0 OR turn % 2 = 1""")
def dm23_whole_image(t: Tables) -> DataFrame:
    """Images of which nothing but the recognised lines is left, with a hole where these aren't complete."""
    ocr = t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("string").alias("image_id"), col("text").alias("content"), (col("turn") % 2 == 0).alias("complete"))
    return B.whole_image_fallback(B.segments(ocr), ocr).select("document_id", "image_id", "ord", "status", "text")


@query("SELECT n_nationkey, (1000 - n_nationkey)::INT AS \"end\", (n_nationkey % 3 = 2) AS previous, CASE n_nationkey % 3 WHEN 1 THEN 0 ELSE 2 END::INT AS history FROM nation WHERE n_nationkey % 3 > 0")
def dm26_windows(t: Tables) -> DataFrame:
    """Request windows under a budget that has room for all, or for the source alone; a token is a character."""

    @F.pandas_udf("end int, previous boolean, history int")
    def planned(key: pd.Series) -> pd.DataFrame:
        out = []
        for k in key:
            plan = align.plan_window("x" * 1000, 0, 1000 - k, ["h" * 20] * 2, None, "r" * 30, len, {"context": 2000 if k % 3 == 2 else 1530, "output": 900, "margin": 0})
            out.append((plan["end"], plan["previous"], plan["history"]))
        return pd.DataFrame(out, columns=["end", "previous", "history"])

    return t.nation.filter("n_nationkey % 3 > 0").select("n_nationkey", planned("n_nationkey").alias("p")).select("n_nationkey", "p.*")


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN NULL WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'NOT_JSON' WHEN 3 THEN 'NOT_OBJECT' ELSE 'ACTION' END AS code FROM conversations")
def dm29_proposals(t: Tables) -> DataFrame:
    """Replies that can be used, were cut off, aren't JSON, no object, or of another action."""
    rest = col("turn") % 5
    body = F.to_json(F.struct(F.when(rest == 4, "other").otherwise("generate").alias("action"), "text"))
    content = F.when(rest == 2, col("text")).when(rest == 3, F.to_json(F.array("text"))).otherwise(body)
    replies = t.conversations.select("conv_id", "turn", content.alias("content"), F.when(rest == 1, "length").otherwise("stop").alias("finish_reason"))
    return B.proposals(replies).select("conv_id", "turn", "code")


@query("SELECT n_nationkey::VARCHAR AS document_id, CASE n_nationkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'VERSION' WHEN 2 THEN 'DIGEST' WHEN 3 THEN 'GRAMMAR' WHEN 4 THEN 'EMPTY' ELSE 'IDENTITY' END AS state FROM nation")
def dm31_results(t: Tables) -> DataFrame:
    """Finished documents as a client takes them, with a fault of each kind."""
    rest = col("n_nationkey") % 6
    xml = T.update(F.when(rest == 4, "").when(rest == 3, "<p/>").otherwise(F.concat(F.lit("<p>"), "n_name", F.lit("</p>"))), "document")
    rows = t.nation.select(col("n_nationkey").cast("string").alias("document_id"), F.when(rest == 1, 2).otherwise(1).alias("version"), xml.alias("xml"), F.lit(1).alias("block_count"), rest.alias("rest"))
    results = rows.withColumn("sha256", T.sha256(F.when(col("rest") == 2, F.concat("xml", F.lit("\r\n"))).otherwise(col("xml"))))
    return B.results_verified(results.drop("rest"), t.nation.filter(rest != 5).select(col("n_nationkey").cast("string").alias("document_id"), F.lit(1).alias("version")))


@query("SELECT r_name AS topic, '<p>' || r_name || '</p>' AS xml FROM region")
def dm32_examples(t: Tables) -> DataFrame:
    """Style examples, each of which is one valid block."""
    return B.examples(t.region.select(col("r_name").alias("topic"), F.concat(F.lit("<p>"), "r_name", F.lit("</p>")).alias("xml")))


@query("SELECT turn, count(*) AS n, sum((length(text) > 200)::INT)::BIGINT AS long FROM conversations GROUP BY 1")
def sql_functions(t: Tables) -> DataFrame:
    """The registered functions in SQL: valid paragraphs, their nodes and their plain text."""
    register.register(t.spark)
    t.conversations.select("turn", T.update(T.paragraph(col("text"))).alias("xml"), T.paragraph(col("text")).alias("block"), "text").createOrReplaceTempView("docflow_turns")
    return t.spark.sql("SELECT turn, count_if(doc_valid(xml)) AS n, count_if(length(doc_plain_text(block)) > 200 AND doc_similarity(text, text) >= 0) AS long FROM docflow_turns GROUP BY turn")
