"""Queries of sources and sinks: tables written as the files that the sources read, and read back.

Nations stand for documents that are described by files, their suppliers for images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events
from ..sources import files, sinks
from ..sources.shared import scratch
from ..sources.versions import Conflict
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col


def filed(rows: DataFrame, name: str, t: Tables) -> str:
    """``key, value`` written as a text file for each key."""
    path = scratch(t.spark, name)
    rows.select("key", "value").write.partitionBy("key").text(path)
    return path


FAULTS = """CASE n_nationkey % 5 WHEN 1 THEN 'DOCUMENT_ID' WHEN 2 THEN CASE WHEN k > 0 THEN 'DUPLICATE_ORDER' ELSE 'EMPTY_ORDER' END WHEN 3 THEN 'UNKNOWN_IMAGE' WHEN 4 THEN CASE WHEN k > 0 THEN 'DUPLICATE_IMAGE' ELSE 'EMPTY_ORDER' END ELSE CASE WHEN k > 0 THEN NULL ELSE 'EMPTY_ORDER' END END"""


def manifest_files(t: Tables) -> str:
    images = t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), "s_suppkey"))).alias("ids"))
    n = t.nation.join(images, col("n_nationkey") == col("s_nationkey"), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    rest = col("n_nationkey") % 5
    image = F.transform("ids", lambda i: F.struct(i.alias("image_id"), F.concat(F.lit("img/"), i).alias("path")))
    made = n.select(
        col("n_nationkey").alias("key"),
        F.concat(F.when(rest == 1, "no id ").otherwise("n"), col("n_nationkey").cast("string")).alias("document_id"),
        F.when(rest == 4, F.concat(image, F.slice(image, 1, 1))).otherwise(image).alias("images"),
        F.when(rest == 2, F.concat("ids", F.slice("ids", 1, 1))).when(rest == 3, F.concat("ids", F.array(F.lit("other")))).otherwise(F.reverse("ids")).alias("ordered_image_ids"),
    )
    return filed(made.select("key", F.to_json(F.struct("document_id", "images", "ordered_image_ids")).alias("value")), "manifests", t)


@query(f"SELECT CASE WHEN n_nationkey % 5 = 1 THEN 'no id ' ELSE 'n' END || n_nationkey AS document_id, 'zh-CN' AS lang, {FAULTS} AS fault FROM (SELECT n_nationkey, count(s_suppkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)")
def sc1_manifests(t: Tables) -> DataFrame:
    """Manifest files with the first rule that each breaks."""
    return files.manifests(t.spark, manifest_files(t)).select("document_id", "lang", "fault")


@query("SELECT 'n' || s_nationkey AS document_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY 's' || s_suppkey DESC)::INT - 1 AS image_ord, 's' || s_suppkey AS image_id, 'img/s' || s_suppkey AS path FROM supplier WHERE s_nationkey % 5 = 0")
def sc1_ordered_images(t: Tables) -> DataFrame:
    """Images of sound manifests in final order."""
    return files.ordered_images(files.manifests(t.spark, manifest_files(t)))


def named_files(t: Tables) -> str:
    return filed(t.nation.select(col("n_nationkey").alias("key"), col("n_name").alias("value")), "artifacts", t)


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256, strlen(n_name)::BIGINT + 1 AS bytes FROM nation")
def sc2_artifacts(t: Tables) -> DataFrame:
    """Files with digest and size, each as its checkpoint wants it."""
    found = files.artifacts(t.spark, named_files(t))
    key = F.regexp_extract("path", r"key=(\d+)", 1).cast("int")
    wanted = found.select("path", key.alias("n_nationkey")).join(t.nation, "n_nationkey").select("path", "n_nationkey", T.sha256(F.concat("n_name", F.lit("\n"))).alias("wanted_sha256"))
    return files.verified(found, wanted).filter("content IS NOT NULL").select("n_nationkey", "sha256", "bytes")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'escapes' WHEN n_nationkey % 7 = 1 THEN 'changed' ELSE 'good' END AS state FROM nation")
def sc3_guarded_paths(t: Tables) -> DataFrame:
    """References to artifacts: those that leave the folder, and those whose content has another digest."""
    rest = col("n_nationkey") % 7
    refs = t.nation.select("n_nationkey", F.concat(F.when(rest == 0, "a/../../").otherwise("a/b..c/"), "n_name").alias("path"), T.sha256(col("n_name")).alias("sha256"), T.sha256(F.concat("n_name", F.when(rest == 1, "x").otherwise(""))).alias("wanted_sha256"))
    return refs.select("n_nationkey", files.reference_state(col("path"), col("sha256"), col("wanted_sha256")).alias("state"))


@query("SELECT n_nationkey, 'data:image/' || CASE n_nationkey % 3 WHEN 0 THEN 'png' ELSE 'jpeg' END || ';base64,' || base64(encode(n_name)) AS url FROM nation WHERE n_nationkey % 4 > 0")
def sc4_data_urls(t: Tables) -> DataFrame:
    """PNG and JPEG files as addresses; others are left out."""
    ending = F.when(col("n_nationkey") % 4 == 0, ".gif").when(col("n_nationkey") % 3 == 0, ".PNG").when(col("n_nationkey") % 3 == 1, ".jpg").otherwise(".jpeg")
    made = files.data_urls(t.nation.select(F.concat(col("n_nationkey").cast("string"), ending).alias("path"), F.encode("n_name", "UTF-8").alias("content")), keep=["path"])
    return made.select(F.regexp_extract("path", r"^\d+", 0).cast("int").alias("n_nationkey"), "url")


@query("SELECT row_number() OVER (ORDER BY r_name DESC)::INT - 1 AS ord, '<p>' || r_name || '</p>' AS xml FROM region")
def sc6_fragments(t: Tables) -> DataFrame:
    """Fragments in the order in which they are asked for, not that of their names."""
    path = filed(t.region.select(col("r_name").alias("key"), F.concat(F.lit("<p>"), "r_name", F.lit("</p>")).alias("value")), "fragments", t)
    found = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy(F.desc("path")).collect()  # a file for each argument
    return files.fragments(t.spark, [r["path"] for r in found]).select("ord", F.rtrim("xml", F.lit("\n")).alias("xml"))


@query("SELECT r_name AS run, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def sc7_metrics(t: Tables) -> DataFrame:
    """Figures of all runs, named by their files."""
    sums = t.region.join(t.nation, col("n_regionkey") == col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))
    path = filed(sums.select(col("r_name").alias("key"), F.to_json(F.struct("nations")).alias("value")), "metrics", t)
    return files.metrics(t.spark, f"{path}/*/*.txt").select(F.url_decode(F.regexp_extract("file", "key=([^/]+)", 1)).alias("run"), "nations")


@query("SELECT conv_id, arg_max(length(text), turn)::BIGINT AS tokens FROM conversations GROUP BY 1")
def sc8_cache_capacity(t: Tables) -> DataFrame:
    """The last capacity that a log reports, with and without separators."""
    line = F.concat(F.lit("INFO KV cache size: "), F.when(col("turn") % 2 == 0, F.format_number(F.length("text"), 0)).otherwise(F.length("text").cast("string")), F.lit(" tokens\n"))
    logs = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("log"))
    return logs.select("conv_id", T.last_capacity(col("log")).alias("tokens"))


@query("SELECT doc_id AS file, line_no::INT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS k FROM documents) WHERE line_no >= k - 3")
def sc9_tail_lines(t: Tables) -> DataFrame:
    """The last three lines of each document."""
    return files.tail_lines(t.documents.select(col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")), 3).select("file", "line_no", "line")


@query("SELECT conv_id AS stream, turn::VARCHAR AS id, role AS event, text AS data FROM conversations")
def sc10_event_frames(t: Tables) -> DataFrame:
    """Server-sent events: a frame for each turn, its text a data line for each of its own."""
    data = F.concat(F.lit("data: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")))
    frame = F.concat(F.lit(": note\nid: "), col("turn").cast("string"), F.lit("\nevent: "), "role", F.lit("\n"), data, F.when(col("turn") % 2 == 0, "\n\n").otherwise("\n\n\n"))
    bodies = t.conversations.groupBy(col("conv_id").alias("stream")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("body"))
    return files.event_frames(bodies).select("stream", "id", "event", "data")


@query("SELECT sum(strlen(n_name) + 1)::BIGINT AS bytes FROM nation")
def sc12_used_bytes(t: Tables) -> DataFrame:
    return files.used_bytes(files.artifacts(t.spark, named_files(t))).select(col("bytes").cast("long").alias("bytes"))


def recognised(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.conversations.select(col("conv_id").alias("document_id"), col("turn").alias("image_id"), T.sha256(col("text")).alias("sha256"), "role", col("text").alias("content"), (col("turn") % 2 == 0).alias("complete"), (col("turn") % 4 + 1).alias("attempts"))
    return rows.select("document_id", "image_id", "sha256"), rows.filter("role <> 'system'").drop("role")


@query("SELECT conv_id AS document_id, turn AS image_id, sha256(text) AS content FROM conversations WHERE role <> 'system' AND turn % 2 = 0")
def sc13_imported_ocr(t: Tables) -> DataFrame:
    """Complete recognised texts of an earlier run, for the same images."""
    return files.imported_ocr(*recognised(t)).select("document_id", "image_id", T.sha256(col("content")).alias("content"))


@query("SELECT conv_id AS document_id, turn AS image_id, sha256(text) AS content FROM conversations WHERE role <> 'system' AND (turn % 2 = 0 OR turn % 4 + 1 = 3)")
def sc14_seeded_ocr(t: Tables) -> DataFrame:
    """As in sc13, and failed ones that have used up their attempts."""
    return files.imported_ocr(*recognised(t), failed_attempts=3).select("document_id", "image_id", T.sha256(col("content")).alias("content"))


@query("SELECT 'c' || conv_id || '-' || turn AS \"taskId\", role AS title FROM conversations")
def sc15_tasks(t: Tables) -> DataFrame:
    """Catalogues of client tasks."""
    lists = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("taskId"), col("role").alias("title")))).alias("value"))
    return files.tasks(lists, "taskId:string,title:string")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderkey % 3 = 0 THEN 'READY' WHEN o_orderkey % 5 = 0 THEN 'NORMALIZING' ELSE 'RETAKE_REQUIRED' END AS state FROM orders")
def sc16_recovered_pages(t: Tables) -> DataFrame:
    """Pages after a cold start."""
    pages = t.orders.select("o_orderkey", F.when(col("o_orderstatus") == "F", "READY").otherwise("CAPTURING").alias("state"), (col("o_orderkey") % 3 == 0).alias("has_ready_file"), (col("o_orderkey") % 5 == 0).alias("has_raw_file"))
    return files.recovered_pages(pages).select("o_orderkey", "state")


@query("SELECT r_regionkey, r_name FROM region")
def sk1_published(t: Tables) -> DataFrame:
    """A table published once: a second try leaves it as it is."""
    path = scratch(t.spark, "published")
    sinks.publish(t.region.select("r_regionkey", "r_name"), path)
    try:
        sinks.publish(t.region.select(F.lit(-1).alias("r_regionkey"), "r_name"), path)
        raise AssertionError("a conflict was missed")
    except Conflict:
        return sinks.exported(t.spark, path, "r_regionkey int, r_name string")


@query("SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
def sk3_export(t: Tables) -> DataFrame:
    """An export replaced by one that knows what it replaces; one that doesn't changes nothing."""
    path = scratch(t.spark, "export")
    rows = t.nation.select("n_nationkey", "n_name")
    first = sinks.export(rows, path, 0)
    try:
        sinks.export(rows.limit(1), path, 0)
        raise AssertionError("a conflict was missed")
    except Conflict:
        sinks.export(rows.withColumn("n_name", F.concat("n_name", F.lit("!"))), path, first)
    return sinks.exported(t.spark, path, "n_nationkey int, n_name string")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def sk5_upsert(t: Tables) -> DataFrame:
    """The latest row of each key; changes that come twice change nothing."""
    rows = t.orders.select("o_custkey", "o_orderkey")
    changes = rows.filter("o_orderkey % 2 = 0")
    return sinks.merged(rows.filter("o_orderkey % 2 = 1"), changes.union(changes), ["o_custkey"], "o_orderkey")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click', ts, event_id)::BIGINT AS seq FROM events")
def sk6_event_append(t: Tables) -> DataFrame:
    """Clicks numbered on from each user's other events."""
    rows = t.events.select(col("user_id").alias("document_id"), "event_id", "ts", "event_type")
    first = events.with_sequence(rows.filter("event_type <> 'click'"), ["ts", "event_id"])
    later = events.with_sequence(rows.filter("event_type = 'click'"), ["ts", "event_id"], first.select("document_id", "seq"))
    return first.union(later).select("event_id", "seq")


@query("SELECT event_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events) WHERE seq > user_id % 10 AND seq <= user_id % 10 + 32")
def sk7_events_after(t: Tables) -> DataFrame:
    """Each reader's next page of events, from a cursor of its own."""
    rows = events.with_sequence(t.events.select(col("user_id").alias("document_id"), "event_id", "ts"), ["ts", "event_id"])
    cursors = t.events.select(col("user_id").alias("document_id")).distinct().withColumn("cursor", col("document_id") % 10)
    return events.events_after(rows, cursors).select("event_id", "seq")


@query("SELECT n_nationkey, n_name || ' in ' || coalesce(r_name, '?') || ' @ home' AS made FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def sk12_templates(t: Tables) -> DataFrame:
    """A template filled for each row."""
    rows = t.nation.join(t.region, col("n_regionkey") == col("r_regionkey"), "left")
    return rows.select("n_nationkey", sinks.filled_column("@NATION@ in @REGION@ @ home", {"NATION": col("n_name"), "REGION": F.coalesce("r_name", F.lit("?"))}).alias("made"))


@query("SELECT n_nationkey, '/f/' || n_name AS path, strlen(n_name)::BIGINT AS bytes, CASE WHEN strlen(n_name) <= 8 THEN sha256(n_name) END AS sha256 FROM nation")
def dm30_fingerprint(t: Tables) -> DataFrame:
    """A snapshot's parts: path and size, and the digest of small files."""
    rows = t.nation.select("n_nationkey", F.concat(F.lit("/f/"), "n_name").alias("path"), F.octet_length("n_name").cast("long").alias("bytes"), F.encode("n_name", "UTF-8").alias("content"))
    return files.fingerprints(rows, small=8).select("n_nationkey", "path", "bytes", "sha256")
