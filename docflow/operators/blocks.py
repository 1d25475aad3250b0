"""Blocks: candidates from proposals, their checks, fallback to recognised lines, commit and export."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import cached_property
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import align, tree
from ..sources.shared import stored

#: Stands for what a document holds already, where only its end is checked.
LEAD = "<p>.</p>"
#: Missing characters from which an omission counts.
OMISSION = 8


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def error(code: str, message: str, targets: list[str], **more) -> dict:
    return {"code": code, "message": message, "target_blocks": targets, **more}


# Topics of advice, and the words of a message that lead to them; the first topic with a word counts.
TOPICS = (("style", ("color", "inline", "nesting", "style")), ("structure", ("pre", "blockquote", "code")), ("table", ("table", "row", "cell", "span", "column")))


def advice(message: str) -> str:
    """The topic whose example helps with a message."""
    low = message.lower()
    return next((topic for topic, words in TOPICS if any(w in low for w in words)), "paragraph")


def advice_topic(message: Column) -> Column:
    """The same for a column."""
    topic = F.lit("paragraph")
    for name, words in reversed(TOPICS):
        topic = F.when(F.lower(message).rlike("|".join(words)), name).otherwise(topic)
    return topic


class Compared:
    """An independent text against a valid block."""

    def __init__(self, text: str, node: tree.Node):
        self.text, self.node, self.own = text, node, tree.plain_text(node)
        self.wanted, self.made = tree.structural(text), tree.structural(self.own)

    @cached_property
    def code(self) -> bool:
        return any(n.tag in ("pre", "code") for n in self.node.walk())

    @cached_property
    def extra(self) -> str | None:
        """What the text has beyond the block, if it holds the block's text whole."""
        if self.made not in self.wanted or self.wanted == self.made:
            return None
        before, _, after = self.wanted.partition(self.made) if self.made else ("", "", self.wanted)
        return before + after

    def explained(self) -> bool:
        """Whether code or marks of a chat tell why the block has less."""
        return self.extra is not None and ((self.code and self.made != "") or align.has_markup(self.extra))


#: How a text can relate to a block: the first that holds.
RELATIONS: tuple[tuple[str, Callable[[Compared], bool]], ...] = (
    ("equal", lambda c: c.text == c.own),
    ("non_text_separator", lambda c: c.node.tag == "hr"),
    ("code_whitespace_difference", lambda c: c.wanted == c.made and c.code),
    ("structural_whitespace_only", lambda c: c.wanted == c.made),
    ("xml_contains_more_text", lambda c: c.wanted != "" and c.wanted in c.made),
    ("code_or_control_label_difference", Compared.explained),
    ("xml_is_text_substring", lambda c: c.extra is not None),
    ("uncertain_difference", lambda c: True),
)


def relation(model_text: str, node: tree.Node) -> dict:
    """How an independent text relates to the text of a valid block.

    Only a text of which the block is a real part is a reason for repair: eight or more characters
    that aren't white space are missing, one of them a letter or digit, and neither code nor
    control marks explain it.
    """
    pair = Compared(model_text, node)
    name = next(name for name, holds in RELATIONS if holds(pair))
    partly = name in ("code_or_control_label_difference", "xml_is_text_substring")
    missing = len(align.squeezed(pair.extra)) if partly else None
    gate = name == "xml_is_text_substring" and missing >= OMISSION and any(c.isalnum() for c in pair.extra)
    return {"relation": name, "hard_gate": gate, "missing": missing}


def judged(block: dict) -> dict:
    """A block with its status (ok or pending) and current errors. A valid tree's text counts."""
    errors: list[dict] = []
    ident, xml, text, refs = block["id"], block.get("xml"), block.get("text"), block.get("ocr_refs")
    if not isinstance(text, str):
        errors.append(error("TEXT_TYPE", "text must be a string", [ident]))
    if not (isinstance(refs, list) and all(isinstance(r, str) for r in refs) and len(set(refs)) == len(refs)):
        errors.append(error("REFS_TYPE", "references must be distinct strings", [ident]))
    node = None
    if not isinstance(xml, str):
        errors.append(error("XML_TYPE", "xml must be a string", [ident]))
    else:
        found = tree.validate(tree.envelope(xml))
        errors += (error(i.code, i.message, [ident], line=i.line, column=i.column, xpath=i.xpath, topic=advice(i.message)) for i in found)
        if not found:
            roots = tree.parse(tree.envelope(xml)).children
            node = roots[0] if len(roots) == 1 else None
            if node is None:
                errors.append(error("ONE_ROOT", "a block has one root", [ident]))
    diagnostic = None
    if node is not None:
        errors += (error("LINK_TARGET_EMPTY", "a link needs a target", [ident], xpath=n.path()) for n in node.walk() if n.tag == "a" and not n.attrs["href"].strip())
        if isinstance(text, str):
            diagnostic = relation(text, node)
            if diagnostic["hard_gate"]:
                errors.append(error("XML_TEXT_OMISSION", f"{diagnostic['missing']} characters of the text are missing", [ident]))
    made = dict(block, current_errors=errors, representation=diagnostic, status="pending" if errors else "ok")
    if not errors:
        made |= {"model_text": text, "text": tree.plain_text(node)}
    return made


def candidate(value: Any, image_id: str, natural_key: str, lineage: list[str] | None = None) -> dict:
    """A new block from a proposal's value; its id follows from a natural key."""
    value = value if isinstance(value, dict) else {}
    ident = hashlib.sha256(f"{image_id}|{natural_key}".encode()).hexdigest()[:32]
    refs = value.get("ocr_refs")
    block = {
        "id": ident, "version": 0, "image_id": image_id, "lineage": lineage or [ident], "xml": value.get("xml"), "text": value.get("text"),
        "ocr_refs": refs, "errors": [], "guards": [], "repair_attempts": 0, "fallback_source": None, "original_candidate": value,
    }
    made = judged(block)
    made["errors"] = list(made["current_errors"])
    if not (isinstance(refs, list) and all(isinstance(r, str) for r in refs)):
        made["ocr_refs"] = []
    return made


def proposal(content: str | None, finish_reason: str | None, actions: tuple[str, ...] = ("generate", "repair", "read_blocks", "search_blocks")) -> tuple[dict | None, str | None]:
    """The reply as an object, or why it isn't one."""
    if finish_reason != "stop":
        return None, "INCOMPLETE"
    try:
        value = json.loads(content or "")
    except ValueError:
        return None, "NOT_JSON"
    if not isinstance(value, dict):
        return None, "NOT_OBJECT"
    return (value, None) if value.get("action") in actions else (None, "ACTION")


def response_schema(kind: str) -> dict:
    """The JSON schema of a reply: all keys needed, none else allowed."""

    def strict(**fields) -> dict:
        return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}

    text = {"type": "string"}
    block = strict(xml=text, text=text, ocr_refs={"type": "array", "items": text})
    fields = {"action": {"const": kind}, "tail": {"anyOf": [block, {"type": "null"}]}, "blocks": {"type": "array", "items": block}}
    if kind == "repair":
        fields |= {"attempt_id": text, "target_versions": {"type": "object", "additionalProperties": {"type": "integer"}}}
    else:
        claim = strict(
            relation=text, candidate_prefix_count={"type": "integer"}, history_refs={"type": "array", "items": text}, first_history_match=text, whole_image_has_no_new_content={"type": "boolean"}
        )
        fields["overlap_claim"] = {"anyOf": [claim, {"type": "null"}]}
    return strict(**fields)


def spark_type(schema: dict) -> str:
    """The type of Spark that holds what a JSON schema describes."""
    if "anyOf" in schema:
        return spark_type(next(s for s in schema["anyOf"] if s["type"] != "null"))
    match schema.get("type", "string"):
        case "object" if "properties" in schema:
            return f"struct<{', '.join(f'{k}: {spark_type(v)}' for k, v in schema['properties'].items())}>"
        case "object":
            return f"map<string, {spark_type(schema['additionalProperties'])}>"
        case "array":
            return f"array<{spark_type(schema['items'])}>"
        case kind:
            return {"integer": "bigint"}.get(kind, kind)


def parsed_replies(replies: DataFrame, kind: str) -> DataFrame:
    """``replies`` (``content``: JSON) with ``reply`` as the schema of their kind describes it, and the fields that they lack or have beyond it. What isn't
    a JSON object lacks all and has no reply."""
    schema = response_schema(kind)
    keys = F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>"))
    needed = F.array(*map(F.lit, schema["required"]))
    reply = F.when(F.json_object_keys("content").isNotNull(), F.from_json("content", spark_type(schema)))
    return replies.select("*", reply.alias("reply"), F.array_except(needed, keys).alias("missing"), F.array_except(keys, needed).alias("extra"))


def repair_options(target: dict) -> list[dict]:
    """The one repair that needs no judgement: a bare blockquote around one pre is taken off."""
    if target.get("status") != "pending" or not isinstance(target.get("xml"), str) or not isinstance(target.get("text"), str):
        return []
    try:
        root = tree.parse(tree.envelope(target["xml"]))
    except tree.Refused:
        return []
    if not tree.check(root, "update") or len(root.children) != 1:
        return []
    quote = root.children[0]
    alone = quote.tag == "blockquote" and not quote.attrs and [c.tag for c in quote.children] == ["pre"]
    if not alone or any(r.strip() for r in (*root.runs, *quote.runs)):
        return []
    xml = tree.serialize(quote.children[0])
    made = candidate({"xml": xml, "text": target["text"], "ocr_refs": target.get("ocr_refs") or []}, target.get("image_id", ""), "option")
    if made["status"] != "ok" or target["text"].replace("\r\n", "\n") != made["text"]:
        return []
    value = {"xml": xml, "text": made["text"], "ocr_refs": made["ocr_refs"]}
    identity = {"target": target["id"], "version": target["version"], "source": digest({k: target.get(k) for k in ("id", "version", "xml", "text", "ocr_refs")}), "made": digest([value])}
    return [{"option_id": "repair-option:" + digest(identity), "target_versions": {target["id"]: target["version"]}, "blocks": [value]}]


def chosen_option(choice: dict, offered: list[dict], current: dict[str, int]) -> tuple[dict | None, str | None]:
    """The option that a choice names, or why it can't be used."""
    option = next((o for o in offered if o["option_id"] == choice.get("option_id")), None)
    if option is None:
        return None, "NOT_OFFERED"
    if choice.get("target_versions") != option["target_versions"]:
        return None, "SCOPE"
    if any(current.get(k) != v for k, v in option["target_versions"].items()):
        return None, "STALE"
    return option, None


# DataFrame operators

CHECK_DDL = "valid boolean, stage string, code string, message string, line int, column int, xpath string, block_index int"


def validated(rows: DataFrame, xml: str = "xml", kind: str = "update", strict: bool = False) -> DataFrame:
    """``rows`` with ``check``: valid, or the first issue's fields."""

    @F.pandas_udf(CHECK_DDL)
    def first_issue(texts: pd.Series) -> pd.DataFrame:
        found = [next(iter(tree.validate(t, kind, strict)), None) for t in texts]
        out = pd.DataFrame([(i is None, *(i or (None,) * 7)) for i in found], columns=[c.split()[0] for c in CHECK_DDL.split(", ")])
        return out.astype({"line": "Int32", "column": "Int32", "block_index": "Int32"})

    return rows.withColumn("check", first_issue(F.col(xml)))


def representation(rows: DataFrame) -> DataFrame:
    """``rows`` (``xml, text``) with ``relation, hard_gate``; null where the XML isn't one valid block."""

    @F.pandas_udf("relation string, hard_gate boolean")
    def related(xml: pd.Series, text: pd.Series) -> pd.DataFrame:
        nodes = [tree.block_of(x) for x in xml]
        found = [relation(t or "", n) if n is not None else {"relation": None, "hard_gate": None} for n, t in zip(nodes, text, strict=True)]
        return pd.DataFrame({"relation": [f["relation"] for f in found], "hard_gate": pd.array([f["hard_gate"] for f in found], dtype="boolean")})

    return rows.withColumn("r", related("xml", "text")).select(*rows.columns, "r.relation", "r.hard_gate")


def nodes(rows: DataFrame, key: list[str], xml: str = "xml", kind: str = "update") -> DataFrame:
    """All elements of valid XML as rows."""

    @F.pandas_udf("array<struct<node_ord:int,parent_ord:int,depth:int,block_ord:int,tag:string,attrs:map<string,string>,text:string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("node_ord", "parent_ord", "depth", "block_ord", "tag", "attrs", "text"), n, strict=True)) for n in tree.node_rows(t, kind)] for t in texts])

    return rows.select(*key, F.inline(parsed(xml)))


def candidates(rows: DataFrame) -> DataFrame:
    """Candidates from ``document_id, ord, image_id, xml, text, ocr_refs``: ``id, status, text`` and the codes of their errors
    with the topics that advise on them. Ids follow from the image and the place."""

    @F.pandas_udf("id string, status string, text string, codes array<string>, topics array<string>")
    def made(image: pd.Series, place: pd.Series, xml: pd.Series, text: pd.Series, refs: pd.Series) -> pd.DataFrame:
        out = []
        for i, k, x, t, r in zip(image, place, xml, text, refs, strict=True):
            c = candidate({"xml": x, "text": t, "ocr_refs": None if r is None else list(r)}, i, str(k))
            out.append((c["id"], c["status"], c["text"], [e["code"] for e in c["current_errors"]], [e.get("topic") for e in c["current_errors"]]))
        return pd.DataFrame(out, columns=["id", "status", "text", "codes", "topics"])

    return rows.withColumn("c", made("image_id", "ord", "xml", "text", "ocr_refs")).select("document_id", "ord", "image_id", "c.*")


ISSUES = "array<struct<stage: string, code: string, inside: boolean>>"
#: Places that one task counts, by order.
SPAN = 4096


def places(rows: DataFrame, order: str = "ord", span: int = SPAN) -> DataFrame:
    """``rows`` (``document_id`` and a whole-numbered ``order``) with ``place`` from 0 in their document: counted by stretches of the order, so that a
    long document is many tasks, and the counts before each stretch are added."""
    cut = rows.withColumn("stretch", F.floor(F.col(order) / span))
    before = F.sum("n").over(W.partitionBy("document_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    counts = cut.groupBy("document_id", "stretch").agg(F.count("*").alias("n")).select("document_id", "stretch", F.coalesce(before, F.lit(0)).alias("rows before"))
    inside = F.row_number().over(W.partitionBy("document_id", "stretch").orderBy(order)) - 1
    return cut.withColumn("place", inside).join(counts, ["document_id", "stretch"]).withColumn("place", (F.col("place") + F.col("rows before")).cast("int")).select(*rows.columns, "place")


def block_findings(blocks: DataFrame) -> DataFrame:
    """``document_id, ord, whole, first, later`` of blocks (``document_id, ord, xml``): whether one is an element of its own, and its issues as the
    first block of a document and as a later one, ``inside`` it or of the document around it. All that a document's rules ask of a
    block is whether one stands before it."""

    @F.pandas_udf(f"whole boolean, first {ISSUES}, later {ISSUES}")
    def found(xml: pd.Series) -> pd.DataFrame:
        rows = []
        for x in xml:
            try:
                root = tree.parse(tree.envelope(x or "", "document"))
                whole = len(root.children) == 1 and not any(root.runs)
            except tree.Refused:
                whole = False
            listed = lambda before: [{"stage": i.stage, "code": i.code, "inside": i.block_index is not None} for i in tree.document_issues([*before, x])]  # noqa: B023, E731
            rows.append((whole, listed([]), listed([LEAD])) if whole else (False, [], []))
        return pd.DataFrame(rows, columns=["whole", "first", "later"])

    return blocks.select("document_id", "ord", found("xml").alias("f")).select("document_id", "ord", "f.*")


def document_checks(blocks: DataFrame) -> DataFrame:
    """The issues of each document's blocks put together (``document_id, ord, xml``), at the block that each is of.

    Blocks are checked one by one; of a document are added up its first block and whether any of its blocks breaks the schema, which hides what
    comes after that. An issue of the document itself comes once, without a block. Only documents with a block that isn't one element are put together as a text.
    """
    found = stored(block_findings(blocks), "block-findings")
    broken = lambda c: F.exists(c, lambda i: i["stage"] == "schema")
    sums = found.groupBy("document_id").agg(
        F.min("ord").alias("start"), F.bool_and("whole").alias("sound"),
        (F.min_by(broken("first"), "ord") | (F.count_if(broken("later")) > F.min_by(broken("later").cast("int"), "ord"))).alias("hidden"),
    )
    both = places(found).join(sums, "document_id")
    own = F.when(F.col("ord") == F.col("start"), F.col("first")).otherwise(F.col("later"))
    shown = both.filter("sound").select("document_id", "place", "hidden", F.explode(own).alias("i")).filter("NOT hidden OR i.stage = 'schema'")
    inside = shown.filter("i.inside").select("document_id", F.col("place").alias("block_index"), "i.stage", "i.code")
    around = shown.filter("NOT i.inside").select("document_id", F.lit(None).cast("int").alias("block_index"), "i.stage", "i.code").distinct()
    rest = blocks.join(sums.filter("NOT sound").select("document_id"), "document_id", "left_semi")
    return inside.union(around).union(checked_together(rest))


def checked_together(blocks: DataFrame) -> DataFrame:
    """The same from the text of each whole document."""

    @F.pandas_udf("array<struct<block_index:int,stage:string,code:string>>")
    def issues(parts: pd.Series) -> pd.Series:
        return pd.Series([[{"block_index": i.block_index, "stage": i.stage, "code": i.code} for i in tree.document_issues(list(p))] for p in parts])

    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda x: x["xml"])
    return blocks.groupBy("document_id").agg(parts.alias("p")).select("document_id", F.inline(issues("p")))


def visible(candidates: DataFrame) -> DataFrame:
    """``document_id, ord, shown`` of those candidates (``document_id, ord, xml``) that a reader may see yet: each that is valid and
    keeps what is shown a valid document, numbered anew. The first one is that which may stand first, all later ones must be allowed after it."""
    found = stored(block_findings(candidates).select("document_id", "ord", (F.col("whole") & (F.size("first") == 0)).alias("opens"), (F.col("whole") & (F.size("later") == 0)).alias("goes on")), "candidates")
    start = found.filter("opens").groupBy("document_id").agg(F.min("ord").alias("start"))
    kept = found.join(start, "document_id").filter("ord = start OR (ord > start AND `goes on`)").select("document_id", "ord")
    return places(kept).select("document_id", "ord", F.col("place").alias("shown"))


def options(targets: DataFrame) -> DataFrame:
    """The safe repair of each target (``document_id, ord, image_id, xml, text``), if there is one."""

    @F.pandas_udf("option_id string, xml string")
    def offered(image: pd.Series, place: pd.Series, xml: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [repair_options(candidate({"xml": x, "text": t, "ocr_refs": []}, i, str(k))) for i, k, x, t in zip(image, place, xml, text, strict=True)]
        return pd.DataFrame([(o[0]["option_id"], o[0]["blocks"][0]["xml"]) if o else (None, None) for o in found], columns=["option_id", "xml"])

    return targets.withColumn("o", offered("image_id", "ord", "xml", "text")).select("document_id", "ord", "o.*").filter("option_id IS NOT NULL")


def proposals(replies: DataFrame) -> DataFrame:
    """``replies`` (``content, finish_reason``) with why each can't be used, null where it can."""

    @F.pandas_udf("string")
    def code(content: pd.Series, finish: pd.Series) -> pd.Series:
        return pd.Series([proposal(c, f)[1] for c, f in zip(content, finish, strict=True)], dtype=object)

    return replies.withColumn("code", code("content", "finish_reason"))


def examples(rows: DataFrame) -> DataFrame:
    """Style examples (``topic, xml``): each has to be one valid block; another one is an error."""

    @F.pandas_udf("boolean")
    def single(xml: pd.Series) -> pd.Series:
        return pd.Series([tree.block_of(x) is not None for x in xml], dtype=bool)

    good = F.when(single("xml"), F.col("xml")).otherwise(F.raise_error(F.concat(F.lit("not one valid block: "), F.col("topic"))))
    return rows.withColumn("xml", good)


def results_verified(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Finished documents as a client takes them: ``state`` of ``document_id, version, xml, sha256, block_count`` against
    ``document_id, version``. The digest is looked at before the document is parsed."""
    own = wanted.select("document_id", F.col("version").alias("wanted"))
    rows = validated(results.join(own, "document_id", "left"), kind="document")
    state = (
        F.when(F.col("wanted").isNull(), "IDENTITY").when(F.col("version") != F.col("wanted"), "VERSION").when(F.sha2("xml", 256) != F.col("sha256"), "DIGEST")
        .when(~F.col("check.valid"), "GRAMMAR").when((F.col("block_count") == 0) != (F.col("xml") == tree.envelope("", "document")), "EMPTY").otherwise("OK")
    )
    return rows.select("document_id", state.alias("state"))


def tag_histogram(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy("tag").agg(F.count("*").alias("n"))


def segments(ocr: DataFrame) -> DataFrame:
    """Source lines of ``document_id, image_id, content`` with ids and offsets."""

    @F.pandas_udf("array<struct<source_id:string,start:int,end:int,text:string>>")
    def lines(image: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("source_id", "start", "end", "text"), x, strict=True)) for x in align.source_lines(c or "", i)] for i, c in zip(image, content, strict=True)])

    return ocr.select("document_id", "image_id", F.posexplode(lines("image_id", "content")).alias("line_no", "x")).select("document_id", "image_id", "line_no", "x.*")


def fallback(blocks: DataFrame, lines: DataFrame, reserved: DataFrame) -> DataFrame:
    """Pending blocks resolved: recognised lines if each is there, claimed once and not reserved;
    else the block's own text; else unresolved.

    ``blocks``: document_id, ord, status, text, ocr_refs. ``lines``: document_id, source_id, line_no,
    text. ``reserved``: document_id, source_id. Adds ``status, text, fallback_source``.
    """
    claims = blocks.select("document_id", "ord", F.explode(F.array_distinct("ocr_refs")).alias("source_id"))
    claims = claims.withColumn("claimed", F.count("*").over(W.partitionBy("document_id", "source_id")))
    claims = claims.join(lines.select("document_id", "source_id", "line_no", F.col("text").alias("line")), ["document_id", "source_id"], "left")
    held = reserved.select("document_id", "source_id").distinct().withColumn("held", F.lit(True))
    claims = claims.join(held, ["document_id", "source_id"], "left")
    sound = F.bool_and(F.col("line").isNotNull() & (F.col("claimed") == 1) & F.col("held").isNull())
    texts = claims.groupBy("document_id", "ord").agg(sound.alias("sound"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    joined = F.rtrim(F.array_join(F.transform("parts", lambda p: p["line"]), ""), F.lit("\r\n"))
    out = blocks.join(texts, ["document_id", "ord"], "left")
    unique = F.size(F.array_distinct("ocr_refs")) == F.size("ocr_refs")
    source = F.when(F.coalesce(F.col("sound") & unique, F.lit(False)) & (F.trim(joined) != ""), "ocr").when(F.trim("text") != "", "vlm_text")
    pending = F.col("status") == "pending"
    return out.withColumns({
        "fallback_source": F.when(pending, source),
        "new_status": F.when(~pending, F.col("status")).when(source.isNull(), "unresolved").otherwise("fallback"),
        "new_text": F.when(~pending, F.col("text")).when(source == "ocr", joined).when(source == "vlm_text", F.col("text")),
    }).select(*(c for c in blocks.columns if c not in ("status", "text")), F.col("new_status").alias("status"), F.col("new_text").alias("text"), "fallback_source")


def whole_image_fallback(lines: DataFrame, ocr: DataFrame) -> DataFrame:
    """One block with all lines of an image, and a hole where the recognition isn't complete."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "source_id", "text")))
    whole = lines.groupBy("document_id", "image_id").agg(parts.alias("p")).select(
        "document_id", "image_id", F.lit(0).alias("ord"), F.lit("fallback").alias("status"),
        F.transform("p", lambda x: x["source_id"]).alias("ocr_refs"), F.rtrim(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("\r\n")).alias("text"),
    )
    holes = ocr.filter(~F.coalesce("complete", F.lit(False))).select(
        "document_id", "image_id", F.lit(1).alias("ord"), F.lit("unresolved").alias("status"), F.array().cast("array<string>").alias("ocr_refs"), F.lit(None).cast("string").alias("text")
    )
    return whole.unionByName(holes)


def documents(blocks: DataFrame) -> DataFrame:
    """One document for each id: blocks in order in their envelope, and whether it has holes."""
    parts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("xml", F.lit("")).alias("xml"))))
    body = F.array_join(F.transform("parts", lambda p: p["xml"]), "")
    hole = F.col("status") == "unresolved"
    start, _, end = tree.envelope("\0", "document").partition("\0")
    grouped = blocks.groupBy("document_id").agg(parts.alias("parts"), F.bool_or(hole).alias("some"), F.bool_and(hole).alias("all"))
    status = F.when(F.col("all"), "unavailable").when(F.col("some"), "partial").otherwise("complete")
    return grouped.select("document_id", F.concat(F.lit(start), body, F.lit(end)).alias("xml"), status.alias("xml_status"))


def rendered(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """``rows`` with ``html`` and ``plain`` of their valid documents."""

    @F.pandas_udf("html string, plain string")
    def made(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            roots = tree.parse(t).children if t is not None and not tree.validate(t, "document") else None
            out.append((None, None) if roots is None else ("\n".join(map(tree.html, roots)), "\n\n".join(map(tree.plain, roots))))
        return pd.DataFrame(out, columns=["html", "plain"])

    return rows.withColumn("r", made(xml)).select(*rows.columns, "r.html", "r.plain")


def block_report(blocks: DataFrame) -> DataFrame:
    """A Markdown report of a document's blocks; fences are longer than any in the text."""
    from ..functions import text as T

    body = F.coalesce("text", F.lit(""))
    part = F.concat(F.lit("## "), F.col("ord").cast("string"), F.lit(" "), F.col("status"), F.lit("\n\n"), T.fence(body), F.lit("\n"), body, F.lit("\n"), T.fence(body), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"))))
    return blocks.groupBy("document_id").agg(parts.alias("p")).select("document_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("report"))


def aligned(pairs: DataFrame, source: str, output: str) -> DataFrame:
    """``pairs`` with ``matched, coverage, support`` by character alignment. Pairs are dealt out by their texts first, since
    a pair costs much more than its bytes tell."""
    pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, F.xxhash64(source, output))

    @F.pandas_udf("matched long, coverage double, support double")
    def made(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align.alignments(list(zip(a, b, strict=True))), columns=["matched", "coverage", "support"]).astype({"coverage": float, "support": float})

    out = pairs.withColumn("r", made(source, output))
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c.rpartition(".")[2])
    return out.select(*pairs.columns, "r.matched", clean("r.coverage"), clean("r.support"))


def matching_nodes(rows: DataFrame, checks: list[dict]) -> DataFrame:
    """Visual checks over blocks ``document_id, ord, image_id, xml``: how many blocks match each, and whether
    that is within its limits. The check list is a small parameter."""
    if len({c["id"] for c in checks}) != len(checks) or any(c.get("max") is not None and c["max"] < c.get("min", 1) for c in checks):
        raise ValueError("checks need distinct ids and max not below min")
    marks = {"bold": lambda n: n.tag == "b", "link": lambda n: n.tag == "a", "highlight": lambda n: n.attrs.get("background-color"), "text_color": lambda n: n.attrs.get("text-color"), "content": lambda n: n.parent is None or n.parent.parent is None}

    def hit(c: dict, image: str, root: tree.Node) -> bool:
        if c.get("image_id") not in (None, image):
            return False
        for n in root.walk():
            mark = marks[c["kind"]](n)
            if mark and c.get("color") in (None, mark) and re.search(c["pattern"], n.all_text()):
                return True
        return False

    @F.pandas_udf("array<string>")
    def hits(image: pd.Series, xml: pd.Series) -> pd.Series:
        roots = [tree.block_of(x) for x in xml]
        return pd.Series([[c["id"] for c in checks if r is not None and hit(c, i, r)] for i, r in zip(image, roots, strict=True)])

    found = rows.select("document_id", "ord", F.explode(hits("image_id", "xml")).alias("check_id"))
    counted = found.groupBy("document_id", "check_id").agg(F.count("*").alias("actual"), F.array_sort(F.collect_set("ord")).alias("block_ids"))
    limits = rows.sparkSession.createDataFrame([(c["id"], c.get("min", 1), c.get("max")) for c in checks], "check_id string, least int, most int")
    every = rows.select("document_id").distinct().withColumn("check_id", F.explode(F.array(*(F.lit(c["id"]) for c in checks)))).join(F.broadcast(limits), "check_id")
    out = every.join(counted, ["document_id", "check_id"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    passed = (F.col("actual") >= F.col("least")) & (F.col("most").isNull() | (F.col("actual") <= F.col("most")))
    return out.select("document_id", "check_id", "actual", F.coalesce("block_ids", F.array().cast("array<int>")).alias("block_ids"), passed.alias("passed"))
