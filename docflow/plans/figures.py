"""Queries of the figures over tables of the engine's shape, made from conversations and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import figures
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col
SAMPLES = "SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample FROM events"


def samples(t: Tables) -> DataFrame:
    sample = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t.events.select(col("user_id").alias("run_id"), sample.alias("sample"), F.when(col("event_type") == "purchase", "baseline").alias("label"), col("value").alias("used"))


def summary_sql(since: int) -> str:
    return f"""SELECT user_id AS run_id, count(*) AS n, arg_min(value, sample) AS first, arg_max(value, sample) AS last, max(value) AS peak, (arg_max(sample, row(value, -sample)))::INT AS peak_sample,
        coalesce(arg_min(value, sample) FILTER (WHERE event_type = 'purchase'), arg_min(value, sample)) AS baseline FROM ({SAMPLES}) WHERE sample >= {since} GROUP BY 1"""


@query(summary_sql(0))
def ag10_memory_summary(t: Tables) -> DataFrame:
    """Readings of each run: first, last, peak and baseline."""
    return figures.memory_summary(samples(t))


@query(summary_sql(3))
def ag11_memory_since(t: Tables) -> DataFrame:
    """The same from the fourth sample on."""
    return figures.memory_summary(samples(t), since=3)


@query("""SELECT user_id AS document_id, count(*) FILTER (WHERE event_type <> 'error') AS n_live, max(ms) FILTER (WHERE event_type <> 'error') AS most_ms, quantile_disc(ms, 0.5) FILTER (WHERE event_type <> 'error') AS median_ms, quantile_disc(ms, 0.95) FILTER (WHERE event_type <> 'error') AS p95_ms
    FROM (SELECT user_id, event_type, floor(value * 10)::BIGINT AS ms FROM events) GROUP BY 1""")
def ag12_delivery(t: Tables) -> DataFrame:
    """How long live events took to each document's reader; errors stand for replayed ones."""
    sent = col("event_id") * 1000
    rows = t.events.select(col("user_id").alias("document_id"), sent.alias("sent_ms"), (sent + F.floor(col("value") * 10)).alias("received_ms"), (col("event_type") == "error").alias("replayed"))
    return figures.delivery(rows)


@query(r"""SELECT conv_id::VARCHAR AS document_id, sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS n_words,
    coalesce(arg_min(trim(text, ' '), turn) FILTER (WHERE turn % 4 = 2 AND trim(text, ' ') <> ''), arg_min(trim(text, ' '), turn) FILTER (WHERE turn % 4 = 1 AND trim(text, ' ') <> ''), 'untitled') AS title FROM conversations GROUP BY conv_id""")
def ag13_words_and_title(t: Tables) -> DataFrame:
    """Documents' sizes and titles: every fourth turn is a title, the one before it a heading."""
    tag = F.when(col("turn") % 4 == 2, "title").when(col("turn") % 4 == 1, "h2").otherwise("p")
    xml = F.concat(F.lit("<"), tag, F.lit(">"), T.escaped(col("text")), F.lit("</"), tag, F.lit(">"))
    return figures.words_and_title(t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").alias("ord"), xml.alias("xml"), "text"))


@query("SELECT conv_id AS document_id, ref, count(*) AS claims FROM (SELECT DISTINCT conv_id, turn, unnest(['l' || turn, 'l' || (turn // 2), 'l' || turn]) AS ref FROM conversations) GROUP BY 1, 2")
def ag14_claims(t: Tables) -> DataFrame:
    """How many blocks claim a line; one that names it twice counts once."""
    ref = lambda c: F.concat(F.lit("l"), c.cast("string"))
    refs = F.array(ref(col("turn")), ref(F.expr("turn div 2")), ref(col("turn")))
    return figures.claim_counts(t.conversations.select(col("conv_id").alias("document_id"), col("turn").alias("ord"), refs.alias("ocr_refs")))


@query("""SELECT user_id AS document_id, event_type AS image_id, count(*) FILTER (WHERE event_id % 3 <> 0) AS repairs, count(*) FILTER (WHERE event_id % 5 = 0) AS applied, count(*) FILTER (WHERE event_id % 5 = 1) AS declined,
    CASE WHEN sum(event_id % 4) > 0 THEN round(sum(event_id % 1000) / sum(event_id % 4), 3) END AS per_second FROM events GROUP BY 1, 2""")
def ag16_call_sums(t: Tables) -> DataFrame:
    """Repairs, choices and speed (AG15) of each image's calls."""
    action = F.when(col("event_id") % 5 == 0, "apply_repair_option").when(col("event_id") % 5 == 1, "decline_repair_option").otherwise("submit")
    rows = t.events.select(col("user_id").alias("document_id"), col("event_type").alias("image_id"), F.when(col("event_id") % 3 == 0, "generate").otherwise("repair").alias("kind"), action.alias("action"), (col("event_id") % 1000).alias("tokens"), (col("event_id") % 4).alias("seconds"))
    return figures.call_sums(rows)


@query("SELECT event_id AS call_id, event_id % 3 <> 0 AS known, event_id % 3 <> 0 AND event_id % 4 <> 0 AS matches, event_id % 3 <> 0 AND event_id % 5 <> 0 AND 100 + (event_id % 4 = 0)::INT + 40 + event_id % 7 <= 145 AS fits FROM events")
def j15_budgets(t: Tables) -> DataFrame:
    """Planned calls against what they used."""
    planned = t.events.select(col("event_id").alias("call_id"), F.lit(100).alias("inspected"), F.when(col("event_id") % 5 == 0, 10).otherwise(90).alias("most_output"), F.lit(145).alias("context"))
    used = t.events.filter("event_id % 3 <> 0").select(col("event_id").alias("call_id"), (100 + (col("event_id") % 4 == 0).cast("int")).alias("prompt_tokens"), (40 + col("event_id") % 7).alias("output_tokens"))
    return figures.budgets(planned, used)


@query("""WITH s AS (SELECT user_id, floor(value)::BIGINT::VARCHAR AS message, min(sample) AS seq FROM (""" + SAMPLES + """) GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS back FROM s) SELECT user_id AS document_id, (row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1)::INT AS place, message FROM b WHERE back <= 12""")
def tk4_recent_feedback(t: Tables) -> DataFrame:
    """The last twelve different messages of each document."""
    return figures.recent_feedback(samples(t).select(col("run_id").alias("document_id"), col("sample").alias("seq"), F.floor("used").cast("string").alias("message")))


@query("SELECT conv_id AS document_id, list(id ORDER BY turn, k) AS ids FROM (SELECT conv_id, id, min(turn) AS turn, arg_min(k, turn) AS k FROM (SELECT conv_id, turn, unnest([role, 't' || (turn // 2)]) AS id, unnest([0, 1]) AS k FROM conversations) GROUP BY 1, 2) GROUP BY 1")
def so1_union_of_lists(t: Tables) -> DataFrame:
    """Ids of lists in order of their first occurrence."""
    ids = F.array("role", F.concat(F.lit("t"), F.expr("turn div 2").cast("string")))
    return figures.ordered_union(t.conversations.select(col("conv_id").alias("document_id"), col("turn").alias("place"), ids.alias("ids")))


@query("SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(a.v, b.v, c.v) AS v FROM (SELECT s_suppkey AS k, 's' AS v FROM supplier) a FULL JOIN (SELECT c_custkey AS k, 'c' AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k FULL JOIN (SELECT DISTINCT o_custkey AS k, 'o' AS v FROM orders) c ON coalesce(a.k, b.k) = c.k")
def so2_first_of_each(t: Tables) -> DataFrame:
    """Keys of three tables with the row of the first that has them."""
    side = lambda df, key, v: df.select(col(key).cast("long").alias("k"), F.lit(v).alias("v"))
    return figures.first_of_each([side(t.supplier, "s_suppkey", "s"), side(t.customer.filter("c_custkey % 2 = 0"), "c_custkey", "c"), side(t.orders, "o_custkey", "o")], "k")


@query("SELECT user_id AS document_id, event_type AS code, (sample % 2)::VARCHAR AS message, min(sample)::INT AS seq, arg_max(value, sample) AS record FROM (" + SAMPLES + ") GROUP BY 1, 2, 3")
def so3_distinct_errors(t: Tables) -> DataFrame:
    """One error for each code and message."""
    sample = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.select(col("user_id").alias("document_id"), col("event_type").alias("code"), sample.alias("seq"), col("value").alias("record"))
    return figures.distinct_errors(rows.withColumn("message", (col("seq") % 2).cast("string")))


@query("SELECT conv_id AS document_id, conv_id % 3 <> 1 OR count(*) = 1 AS disjoint, conv_id % 3 <> 2 OR count(*) = 0 AS exact FROM conversations GROUP BY 1")
def so4_lineage(t: Tables) -> DataFrame:
    """Rows that share a first candidate in some documents, and lack one in others."""
    root = lambda c: F.concat(F.lit("c"), c.cast("string"))
    least, case = F.min("turn").over(W.partitionBy("conv_id")), col("conv_id") % 3
    rows = t.conversations.withColumn("least", least).withColumn("lineage", F.when(case == 1, F.array_distinct(F.array(root(col("turn")), root(col("least"))))).otherwise(F.array(root(col("turn")))))
    kept = rows.filter("NOT (conv_id % 3 = 2 AND turn = least)").select(col("conv_id").alias("document_id"), col("turn").alias("id"), "lineage")
    return figures.lineage_cover(kept, t.conversations.select(col("conv_id").alias("document_id"), root(col("turn")).alias("root")))


@query("SELECT conv_id AS document_id, conv_id % 4 = 0 AS sound FROM conversations GROUP BY 1")
def so5_orders(t: Tables) -> DataFrame:
    """Final orders that are right, have an image twice, an unknown one, or none."""
    case = col("document_id") % 4
    images = t.conversations.select(col("conv_id").alias("document_id"), col("turn").cast("string").alias("image_id"))
    lists = images.groupBy("document_id").agg(F.array_sort(F.collect_list("image_id")).alias("l"))
    ids = F.when(case == 0, col("l")).when(case == 1, F.concat("l", F.slice("l", 1, 1))).when(case == 2, F.array_append("l", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return figures.sound_orders(lists.select("document_id", ids.alias("ids")), images)


@query("SELECT c_custkey::VARCHAR AS document_id, 'uploads/' || c_custkey || '.jpg' AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0)")
def j10_unregistered(t: Tables) -> DataFrame:
    """Files of uploads that no row names."""
    file = lambda df, key: df.select(col(key).cast("string").alias("document_id"), F.concat(F.lit("uploads/"), col(key).cast("string"), F.lit(".jpg")).alias("path"))
    return figures.unregistered(file(t.customer, "c_custkey"), file(t.orders.filter("o_orderkey % 9 = 0"), "o_custkey"))
