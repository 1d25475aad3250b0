"""Queries of the client's and the service's functions over tables of the engine's shape, with their SQL.

Customers stand for tasks and documents, orders for pages, images and uploads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import client, service
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col

PHASES = ["IDLE", "OCR", "ASSEMBLING", "COMPLETED", "FAILED"]
#: Tasks in SQL; pages are all but the third order of a customer for drafts, uploaded those whose key is even or all.
TASKS = """SELECT c_custkey, c_custkey % 2 = 0 AS draft, c_custkey % 5 AS phase, c_custkey % 11 = 0 AS err, c_custkey % 13 = 0 AS local, c_custkey % 7 = 0 AS offline, c_custkey % 3 > 0 AS accepted, c_custkey % 17 = 0 AS failing,
    count(o_orderkey) AS pages, count(o_orderkey) FILTER (WHERE c_custkey % 4 > 1 AND o_orderkey % 2 = 1) AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


def tasks(t: Tables) -> DataFrame:
    key = col("c_custkey")
    pages = t.orders.groupBy(col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("p"))
    rows = t.customer.join(pages, "c_custkey", "left").withColumn("p", F.coalesce("p", F.array().cast("array<bigint>")))
    text = lambda condition, value: F.when(condition, F.lit(value))
    return rows.select(
        key.alias("task_id"), F.when(key % 7 > 0, key.cast("string")).alias("document_id"), col("c_name").alias("title"), col("c_acctbal").alias("created_at"), col("p").alias("page_ids"),
        F.when(key % 2 == 1, col("p")).alias("submitted_page_ids"), F.when(key % 4 > 1, F.filter("p", lambda x: x % 2 == 0)).otherwise(col("p")).alias("uploaded_page_ids"),
        F.when(key % 17 == 0, col("p")).otherwise(F.array().cast("array<bigint>")).alias("failed_page_ids"), (key % 3 > 0).alias("accepted"),
        F.element_at(F.array(*map(F.lit, PHASES)), (key % 5 + 1).cast("int")).alias("phase"), text(key % 11 == 0, "e").alias("error"), text(key % 13 == 0, "l").alias("local_error"),
        F.lit(None).cast("string").alias("connection_issue"), (key % 22 > 0).alias("retryable"), (key % 6 == 0).alias("hidden"),
    )


@query(f"""SELECT c_custkey AS task_id, CASE WHEN err OR local OR phase = 4 OR (failing AND pages > 0) THEN 'FAILED' WHEN offline THEN 'NOT_CONNECTED' WHEN missing > 0 THEN 'UPLOADING'
    WHEN NOT draft AND accepted AND phase = 3 THEN 'COMPLETED' WHEN phase IN (1, 2) OR NOT draft THEN 'PROCESSING' ELSE 'IDLE' END AS status FROM ({TASKS})""")
def pf10_task_status(t: Tables) -> DataFrame:
    """What each task is shown as."""
    return tasks(t).select("task_id", client.display_status().alias("status"))


@query(f"""SELECT c_custkey AS task_id, CASE WHEN (err AND c_custkey % 22 = 0) OR local OR phase = 4 OR (failing AND pages > 0) THEN 'BLOCKED' WHEN missing > 0 OR (NOT draft AND NOT (accepted AND phase = 3)) OR (draft AND phase = 1) THEN 'WAITING' ELSE 'DONE' END AS step FROM ({TASKS})""")
def st15_task_step(t: Tables) -> DataFrame:
    """What a synchronisation leaves to be done for each task."""
    return tasks(t).select("task_id", client.sync_step().alias("step"))


@query("SELECT c_custkey AS task_id FROM customer WHERE c_custkey % 6 > 0 AND contains(lower(c_name), 'r#00000000')")
def pf9_visible_tasks(t: Tables) -> DataFrame:
    """Tasks that a search of titles finds and that aren't hidden."""
    return client.visible(tasks(t), "  R#00000000 ").select("task_id")


@query("SELECT c_custkey AS task_id, o_orderkey AS page_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 > 1 AND o_orderkey % 2 = 1 AND o_orderstatus = 'F'")
def j11_pages_to_upload(t: Tables) -> DataFrame:
    """Pages that count, are ready and aren't uploaded."""
    pages = t.orders.select(col("o_orderkey").alias("page_id"), F.when(col("o_orderstatus") == "F", "READY").otherwise("NORMALIZING").alias("state"))
    return client.pages_to_upload(tasks(t), pages)


CAPTURES = "SELECT o_custkey AS session_id, CASE o_orderkey % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'CAPTURING' WHEN 2 THEN 'NORMALIZING' WHEN 3 THEN 'READY' WHEN 4 THEN 'FAILED' ELSE 'SAVING' END AS state, o_orderkey % 97 > 0 AS safe FROM orders"


def captures(t: Tables) -> DataFrame:
    states = ["QUEUED", "CAPTURING", "NORMALIZING", "READY", "FAILED", "SAVING"]
    return t.orders.select(col("o_custkey").alias("session_id"), col("o_orderkey").alias("page_id"), F.element_at(F.array(*map(F.lit, states)), (col("o_orderkey") % 6 + 1).cast("int")).alias("state"), (col("o_orderkey") % 97 > 0).alias("safe"))


@query(f"SELECT session_id, count(*) FILTER (WHERE state IN ('QUEUED', 'CAPTURING', 'SAVING')) < 3 AS admitted FROM ({CAPTURES}) GROUP BY 1")
def pf12_captures_admitted(t: Tables) -> DataFrame:
    """Whether a session may capture another page."""
    return client.capture_admission(captures(t))


@query(f"SELECT c_custkey AS session_id, coalesce(bool_and(safe AND state IN ('NORMALIZING', 'READY', 'FAILED')), false) AS may_finish FROM customer LEFT JOIN (SELECT * FROM ({CAPTURES}) WHERE state <> 'QUEUED' AND state <> 'CAPTURING' OR session_id % 3 = 0) ON session_id = c_custkey GROUP BY 1")
def pf13_sessions_finish(t: Tables) -> DataFrame:
    """Whether a session may finish; captures under way are left out of two sessions in three."""
    rows = captures(t).filter("state NOT IN ('QUEUED', 'CAPTURING') OR session_id % 3 = 0")
    return client.finish_gate(t.customer.select(col("c_custkey").alias("session_id")), rows)


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 'job' ELSE state END AS stage FROM (SELECT o_orderkey FROM orders) JOIN (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'CAPTURING' WHEN 2 THEN 'NORMALIZING' WHEN 3 THEN 'READY' WHEN 4 THEN 'FAILED' ELSE 'SAVING' END AS state FROM orders) ON k = o_orderkey")
def j8_page_stages(t: Tables) -> DataFrame:
    """Pages with the stage of their job, if they have one."""
    rows = captures(t).select("page_id", "state")
    return client.page_stages(rows, rows.filter("page_id % 5 = 0").select("page_id", F.lit("job").alias("stage"))).select("page_id", "stage")


@query("SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey % 2 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0")
def j9_orphaned_jobs(t: Tables) -> DataFrame:
    """Jobs of pages that are neither there nor reserved nor deleted."""
    jobs = t.orders.select(col("o_orderkey").alias("page_id"))
    return client.orphan_jobs(jobs, *(jobs.filter(f"page_id % {k} = 0") for k in (2, 3, 5)))


LIMITS = {"upload": 400_000, "images": 12, "data": 10**15, "disk": 10**12, "free": 10**12 - 399_000}


@query("""WITH i AS (SELECT o_custkey, o_orderkey, o_orderkey::VARCHAR AS sha FROM orders WHERE o_orderkey % 4 = 0), r AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 4 = 1), n AS (SELECT o_custkey, count(*) AS k FROM orders WHERE o_orderkey % 4 < 2 GROUP BY 1),
    u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 8 = 4 THEN 'x' ELSE o_orderkey::VARCHAR END AS sha, round(o_totalprice)::BIGINT AS size FROM orders)
    SELECT u.o_orderkey AS upload_id, CASE WHEN size > 400000 THEN 'SIZE' WHEN u.o_custkey % 19 = 0 THEN 'DOCUMENT' WHEN i.sha IS NOT NULL THEN CASE WHEN i.sha = u.sha THEN 'KNOWN' ELSE 'CONFLICT' END WHEN u.o_custkey % 5 = 0 OR u.o_custkey % 7 = 0 THEN 'FROZEN'
    WHEN r.o_orderkey IS NOT NULL THEN 'IN_FLIGHT' WHEN coalesce(k, 0) >= 12 THEN 'COUNT' WHEN size > 399000 - (SELECT count(*) FROM r) THEN 'DISK' END AS code
    FROM u LEFT JOIN i ON i.o_orderkey = u.o_orderkey LEFT JOIN r ON r.o_orderkey = u.o_orderkey LEFT JOIN n ON n.o_custkey = u.o_custkey""")
def pf15_uploads_admitted(t: Tables) -> DataFrame:
    """The first rule that each upload breaks."""
    rows = t.orders.select(col("o_orderkey").alias("upload_id"), col("o_custkey").alias("document_id"), col("o_orderkey").alias("image_id"), F.round("o_totalprice").cast("long").alias("size"))
    own = col("image_id").cast("string")
    uploads = rows.withColumn("sha256", F.when(col("image_id") % 8 == 4, "x").otherwise(own))
    images = rows.filter("image_id % 4 = 0").withColumn("sha256", own).withColumn("size", F.lit(1)).drop("upload_id")
    running = rows.filter("image_id % 4 = 1").select("document_id", "image_id", F.lit(1).alias("reserved"))
    key = col("c_custkey")
    documents = t.customer.filter(key % 19 > 0).select(key.alias("document_id"), F.when(key % 5 == 0, "FAILED").otherwise("OCR").alias("status"), F.when(key % 7 == 0, 1).alias("finalized"))
    return service.upload_admission(uploads, documents, images, running, LIMITS)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 > 1) AS active, (SELECT count(*) FROM orders WHERE o_orderkey % 4 < 2) AS images, (SELECT sum(round(o_totalprice)::BIGINT)::BIGINT FROM orders WHERE o_orderkey % 4 = 1) AS reserved")
def ag9_service_capacity(t: Tables) -> DataFrame:
    """Documents under way, images with uploads, reserved bytes."""
    key = col("c_custkey")
    documents = t.customer.select(F.when(key % 5 == 0, "FAILED").when(key % 5 == 1, "COMPLETED").otherwise("OCR").alias("status"))
    return service.capacity(documents, t.orders.filter("o_orderkey % 4 = 0"), t.orders.filter("o_orderkey % 4 = 1").select(F.round("o_totalprice").cast("long").alias("reserved")))


@query("SELECT o_custkey AS document_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS ocr, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS assembled, count(*) AS total FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def ag8_document_progress(t: Tables) -> DataFrame:
    """How far each document is."""
    images = t.orders.select(col("o_custkey").alias("document_id"), col("o_orderkey").alias("image_id"), (col("o_orderkey") % 3 > 0).alias("ordered"), (col("o_orderstatus") == "F").alias("complete"))
    return service.progress(images, images.filter("image_id % 3 = 1"))


@query("SELECT s_suppkey::VARCHAR AS document_id, row_number() OVER (ORDER BY (s_suppkey % 3 = 0), CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END NULLS FIRST, s_suppkey::VARCHAR)::BIGINT AS place FROM supplier WHERE s_suppkey % 4 > 0 QUALIFY place <= 100")
def tk1_work_queue(t: Tables) -> DataFrame:
    """The order in which documents are worked on."""
    key = col("s_suppkey")
    return service.work_queue(t.supplier.select(key.cast("string").alias("document_id"), F.when(key % 3 > 0, col("s_acctbal")).alias("finalized"), F.when(key % 4 == 0, "FAILED").otherwise("OCR").alias("status")))


@query("SELECT c_custkey AS request_id, s_suppkey AS device_id FROM customer JOIN supplier ON s_suppkey = c_custkey % 20 WHERE s_suppkey % 3 > 0 AND c_custkey % 7 > 0")
def pf14_accepted_tokens(t: Tables) -> DataFrame:
    """Requests whose token is a device's that isn't revoked."""
    tokens = t.supplier.select(col("s_suppkey").alias("device_id"), F.sha2("s_name", 256).alias("digest"), F.when(col("s_suppkey") % 3 == 0, 1).alias("revoked"))
    names = t.supplier.select(col("s_suppkey").alias("k"), "s_name")
    presented = t.customer.withColumn("k", col("c_custkey") % 20).join(names, "k").select(col("c_custkey").alias("request_id"), F.when(col("c_custkey") % 7 == 0, "none").otherwise(col("s_name")).alias("token"))
    return service.accepted(tokens, presented)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS step FROM events),
    s AS (SELECT user_id, seq, CASE WHEN step > 0 THEN 1 ELSE 0 END AS open, 0 AS refused FROM e WHERE seq = 1
    UNION ALL SELECT e.user_id, e.seq, CASE WHEN step > 0 AND open >= 2 THEN open ELSE greatest(open + step, 0) END, refused + CASE WHEN step > 0 AND open >= 2 THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.seq = s.seq + 1)
    SELECT user_id AS device_id, open, refused FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
def ag17_open_streams(t: Tables) -> DataFrame:
    """Streams that each device has open at the end, and openings that were refused."""
    changes = t.events.select(col("user_id").alias("device_id"), F.lit("d").alias("document_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.when(col("event_type").isin("click", "view"), 1).otherwise(-1).alias("step"))
    return service.connections(changes).drop("document_id")


BLOCKS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, text FROM conversations"


@query(f"SELECT conv_id AS request_id, (1 - ord)::INT AS place, ord::INT AS ord, text FROM ({BLOCKS}) WHERE ord < 2 AND conv_id IN (SELECT conv_id FROM ({BLOCKS}) WHERE ord = 1)")
def pf8_read_blocks(t: Tables) -> DataFrame:
    """The second and the first block of each document, in this order."""
    ord_ = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    blocks = t.conversations.select(col("conv_id").alias("document_id"), ord_.alias("ord"), "text")
    asked = blocks.filter("ord = 1").select(col("document_id").alias("request_id"), "document_id", F.array(F.lit(1), F.lit(0)).alias("ordinals"))
    return service.read_blocks(blocks, asked)


@query(f"SELECT conv_id AS request_id, ord::INT AS ord, r::INT AS place FROM (SELECT conv_id, ord, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS r FROM ({BLOCKS}) WHERE contains(text, 'on') AND conv_id % 3 > 0) WHERE r <= 3")
def pf7_search_blocks(t: Tables) -> DataFrame:
    """The first three blocks of each document that hold a text; blank searches find nothing."""
    ord_ = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    blocks = t.conversations.select(col("conv_id").alias("document_id"), ord_.alias("ord"), "text")
    asked = blocks.filter("ord = 0").select(col("document_id").alias("request_id"), "document_id", F.when(col("document_id") % 3 == 0, "  ").otherwise("on").alias("search"))
    return service.search_blocks(blocks, asked)
