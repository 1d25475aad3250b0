"""Queries that plain relational operators express, each with SQL that gives the same rows.

The driver tables stand for the engine's own: a document's text for recognised text, conversation
turns for ordered blocks, events for a service's event log, orders for queued work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

col = F.col


class Tables:
    """The tables of an input folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """Queries by name, their SQL by name, and the decorator that adds a function of the tables to both."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracles[f.__name__] = sql
            return f

        return register

    return queries, oracles, query


QUERIES, ORACLES, query = registry()


@query(r"""
    SELECT min(doc_id) AS first_id, count(*) AS n_ids, max(length(key))::BIGINT AS normalized_characters,
           count(DISTINCT text) = 1 AS byte_identical
    FROM (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') AS key FROM documents)
    WHERE length(key) >= 80 GROUP BY key HAVING count(*) > 1""")
def ag1_duplicate_blocks(t: Tables) -> DataFrame:
    """Texts that are equal once white space is gone, 80 characters or more. Digests keep long
    texts out of the shuffle."""
    keyed = t.documents.select("doc_id", "text", T.stripped(col("text")).alias("key")).filter(F.length("key") >= 80)
    own = F.sha2("text", 256)
    groups = keyed.select("doc_id", F.sha2("key", 256).alias("digest"), own.alias("own"), F.length("key").cast("long").alias("n")).groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_ids"), F.max("n").alias("normalized_characters"), (F.min("own") == F.max("own")).alias("byte_identical")
    )
    return groups.filter("n_ids > 1").drop("digest")


@query("""
    SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P')) v(s)
    LEFT JOIN orders ON o_orderstatus = s GROUP BY s""")
def ag2_status_counts(t: Tables) -> DataFrame:
    """Counts of three statuses, each listed even if there is none of it."""
    counts = t.orders.filter(col("o_orderstatus").isin("F", "O", "P")).groupBy("o_orderstatus").agg(F.count("*").alias("k"))
    known = t.spark.createDataFrame([("F",), ("O",), ("P",)], "status string")
    return known.join(counts, col("status") == col("o_orderstatus"), "left").select("status", F.coalesce("k", F.lit(0)).alias("n"))


@query(r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
                          len(string_split(text, chr(10))) AS k FROM documents),
    placed AS (SELECT *, length(line) + CASE WHEN line_no < k - 1 THEN 1 ELSE 0 END AS size FROM lines),
    summed AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY line_no) AS e FROM placed)
    SELECT doc_id, line_no::BIGINT AS line_no, (e - size)::BIGINT AS start_off, e::BIGINT AS end_off FROM summed WHERE trim(line, E' \t\r') <> ''""")
def wf1_line_segments(t: Tables) -> DataFrame:
    """Lines with running offsets; blank ones go after they were numbered."""
    lines = F.split("text", "\n", -1)
    docs = t.documents.select("doc_id", lines.alias("lines"))
    sizes = F.transform("lines", lambda x, i: F.length(x) + F.when(i < F.size("lines") - 1, 1).otherwise(0))
    docs = docs.withColumn("sizes", sizes)
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip("lines", "sizes")).alias("line_no", "x"))
    e = F.sum("x.sizes").over(W.partitionBy("doc_id").orderBy("line_no"))
    rows = rows.select("doc_id", "line_no", col("x.lines").alias("line"), col("x.sizes").alias("size"), e.alias("end_off"))
    return rows.filter(F.btrim("line", F.lit(" \t\r")) != "").select(
        "doc_id", col("line_no").cast("long").alias("line_no"), (col("end_off") - col("size")).cast("long").alias("start_off"), col("end_off").cast("long").alias("end_off")
    )


@query("""
    WITH marked AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM marked)
    SELECT conv_id, island::BIGINT AS island, min(turn) AS first_turn, count(*) AS n FROM numbered GROUP BY conv_id, island""")
def wf2_islands(t: Tables) -> DataFrame:
    """Consecutive turns of one role."""
    w = W.partitionBy("conv_id").orderBy("turn")
    new = (~col("role").eqNullSafe(F.lag("role").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = t.conversations.select("conv_id", "turn", new.alias("new")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("""
    WITH seqs AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
    sums AS (SELECT user_id, seq, round(sum(value) OVER w, 4) AS score, count(*) OVER w AS k FROM seqs WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT user_id, seq::BIGINT AS start_seq, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, seq DESC) AS r FROM sums WHERE k = 3)
    WHERE r = 1 AND score > 0""")
def wf3_best_window(t: Tables) -> DataFrame:
    """The three consecutive events with the largest sum; ties go to the later start."""
    w = W.partitionBy("user_id").orderBy("seq").rowsBetween(0, 2)
    seqs = t.events.select("user_id", "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    sums = seqs.select("user_id", "seq", F.round(F.sum("value").over(w), 4).alias("score"), F.count("*").over(w).alias("k")).filter("k = 3")
    best = sums.groupBy("user_id").agg(F.max(F.struct("score", "seq")).alias("b")).filter("b.score > 0")
    return best.select("user_id", col("b.seq").cast("long").alias("start_seq"), col("b.score").alias("score"))


@query("""
    SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r IN (2, 3)""")
def wf5_recent3(t: Tables) -> DataFrame:
    """The last three turns without the last."""
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.conversations.select("conv_id", "turn", r.alias("r")).filter("r <= 3 AND r > 1").select("conv_id", "turn")


@query("""
    SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY l_orderkey""")
def wf6_contiguous(t: Tables) -> DataFrame:
    """Whether an order's line numbers have neither gaps nor repeats."""
    n = F.col("l_linenumber")
    g = t.lineitem.groupBy("l_orderkey").agg((F.max(n) - F.min(n) + 1).alias("span"), F.size(F.collect_set(n)).alias("k"), F.count("*").alias("c"))
    return g.select("l_orderkey", ((col("span") == col("k")) & (col("c") == col("k"))).alias("contiguous"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events")
def wf8_event_seq(t: Tables) -> DataFrame:
    """A dense sequence for each user."""
    return t.events.select("event_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS ordinal, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 = turn - min(turn) OVER (PARTITION BY conv_id) AS dense FROM conversations")
def wf9_numbering(t: Tables) -> DataFrame:
    """Blocks numbered from 0, and whether the numbers they came with are dense."""
    w = W.partitionBy("conv_id")
    ordinal = F.row_number().over(w.orderBy("turn")).cast("long") - 1
    return t.conversations.select("conv_id", "turn", ordinal.alias("ordinal"), (ordinal == col("turn") - F.min("turn").over(w)).alias("dense"))


@query("""
    SELECT conv_id, bool_and(ok) AS monotone FROM (SELECT conv_id, coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= length(text), true) AS ok FROM conversations) GROUP BY conv_id""")
def wf10_rank_order(t: Tables) -> DataFrame:
    """Whether a rank never falls along an order."""
    ok = F.coalesce(F.lag(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")) <= F.length("text"), F.lit(True))
    return t.conversations.select("conv_id", ok.alias("ok")).groupBy("conv_id").agg(F.bool_and("ok").alias("monotone"))


@query("""
    SELECT c_custkey FROM customer JOIN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 0 GROUP BY 1 HAVING count(*) = 1) ON o_custkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = c_custkey AND r.o_orderkey % 16 = 1)""")
def j1_unique_refs(t: Tables) -> DataFrame:
    """Customers that exist, are claimed by exactly one order of a batch and aren't reserved by another."""
    return unique_claims(t.orders.filter("o_orderkey % 8 = 0").select(col("o_custkey").alias("ref")), t.customer.select("c_custkey"), t.orders.filter("o_orderkey % 16 = 1").select(col("o_custkey").alias("ref")), "c_custkey")


def unique_claims(claims: DataFrame, known: DataFrame, reserved: DataFrame, key: str) -> DataFrame:
    """Rows of ``known`` that exactly one of ``claims`` (``ref``) names and none of ``reserved``."""
    once = claims.groupBy("ref").agg(F.count("*").alias("k")).filter("k = 1")
    return known.join(once, col(key) == col("ref"), "left_semi").join(reserved, col(key) == col("ref"), "left_anti")


@query("SELECT conv_id, sha256(string_agg(rtrim(text, E'\\r\\n'), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def j2_source_order_concat(t: Tables) -> DataFrame:
    """Texts joined in their source's order, whatever order they come in."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.rtrim("text", F.lit("\r\n")).alias("x"))))
    joined = t.conversations.groupBy("conv_id").agg(parts.alias("parts"))
    return joined.select("conv_id", T.sha256(F.array_join(F.transform("parts", lambda p: p["x"]), "\n")).alias("digest"))


@query("SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0 AND o_totalprice > c_acctbal")
def j4_guarded_lookup(t: Tables) -> DataFrame:
    """A binding joined to what it names, with further predicates on both."""
    c = t.customer.filter("c_acctbal >= 0")
    return t.orders.join(c, (col("o_custkey") == col("c_custkey")) & (col("o_totalprice") > col("c_acctbal"))).select("o_orderkey", "c_custkey", "c_mktsegment")


CHECKS = [("the", r"\bthe\b", 1, 100000), ("mail", r"[\w.]+@[\w.]+", 1, 5), ("never", r"zzzzqq", 1, 9), ("digits", r"\d{6,}", 0, 10_000_000)]


@query(r"""
    SELECT check_id, count(doc_id) AS actual, count(doc_id) BETWEEN lo AND hi AS passed
    FROM (VALUES ('the', '\bthe\b', 1, 100000), ('mail', '[A-Za-z0-9_.]+@[A-Za-z0-9_.]+', 1, 5), ('never', 'zzzzqq', 1, 9), ('digits', '[0-9]{6,}', 0, 10000000)) c(check_id, pattern, lo, hi)
    LEFT JOIN documents ON regexp_matches(text, pattern) GROUP BY check_id, lo, hi""")
def j5_pattern_checks(t: Tables) -> DataFrame:
    """Documents matching each of a list of patterns, between a least and a most number. One scan
    counts all: the list is a parameter, not a table."""
    counts = t.documents.agg(*(F.count_if(col("text").rlike(p)).alias(name) for name, p, _, _ in CHECKS))
    rows = F.array(*(F.struct(F.lit(n).alias("check_id"), col(n).alias("actual"), col(n).between(lo, hi).alias("passed")) for n, _, lo, hi in CHECKS))
    return counts.select(F.inline(rows))


@query("""
    WITH o AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0)
    SELECT c_custkey, pos::BIGINT AS pos, o_orderkey FROM o""")
def j7_ordered_members(t: Tables) -> DataFrame:
    """Finalized owners with their members in final order, by position."""
    owners = t.customer.filter("c_acctbal > 0").select("c_custkey")
    lists = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("final"))
    rows = owners.join(lists, col("c_custkey") == col("o_custkey")).select("c_custkey", F.posexplode("final").alias("pos", "x"))
    return rows.select("c_custkey", (col("pos") + 1).cast("long").alias("pos"), col("x.o_orderkey").alias("o_orderkey"))


@query("""
    SELECT o_orderkey, CASE WHEN max(l_shipdate) IS NULL THEN o_orderstatus WHEN bool_or(l_returnflag = 'R') THEN 'RETURNED' ELSE 'SHIPPED' END AS stage
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def j8_job_stage(t: Tables) -> DataFrame:
    """A page's own state unless a job has one for it."""
    jobs = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(col("l_returnflag") == "R").alias("back"))
    stage = F.when(col("back").isNull(), col("o_orderstatus")).when(col("back"), "RETURNED").otherwise("SHIPPED")
    return t.orders.join(jobs, col("o_orderkey") == col("l_orderkey"), "left").select("o_orderkey", stage.alias("stage"))


@query("""
    SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 997 = 0)
    AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AND s_acctbal NOT BETWEEN -1000 AND 0""")
def j9_orphan_jobs(t: Tables) -> DataFrame:
    """Anti joins in a row: not referenced, not reserved, not deleted."""
    used = t.lineitem.filter("l_orderkey % 997 = 0").select(col("l_suppkey").alias("u")).distinct()
    reserved = t.nation.filter("n_regionkey = 0").select(col("n_nationkey").alias("r"))
    left = t.supplier.join(used, col("s_suppkey") == col("u"), "left_anti").join(reserved, col("s_nationkey") == col("r"), "left_anti")
    return left.filter("s_acctbal NOT BETWEEN -1000 AND 0").select("s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 9 = 0)")
def j10_orphans(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.filter("o_orderkey % 9 = 0"), col("c_custkey") == col("o_custkey"), "left_anti")


@query("""
    SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')
    AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def j11_to_upload(t: Tables) -> DataFrame:
    """Members that are ready and not yet uploaded: a semi and an anti join on one key."""
    ready = t.lineitem.filter("l_linestatus = 'O'").select(col("l_orderkey").alias("a"))
    done = t.lineitem.filter("l_returnflag = 'R'").select(col("l_orderkey").alias("b"))
    o = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey")
    return o.join(ready, col("o_orderkey") == col("a"), "left_semi").join(done, col("o_orderkey") == col("b"), "left_anti")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = e.user_id AND r.event_id = e.event_id)")
def j12_unconsumed(t: Tables) -> DataFrame:
    """Deliveries without a receipt."""
    receipts = t.events.filter("event_type = 'purchase'").select(col("user_id").alias("u"), col("event_id").alias("e"))
    return t.events.select("event_id", "user_id").join(receipts, (col("user_id") == col("u")) & (col("event_id") == col("e")), "left_anti").select("event_id")


@query("""
    SELECT DISTINCT n.l_orderkey, n.l_linenumber FROM lineitem n JOIN lineitem r ON r.l_orderkey = n.l_orderkey AND abs(r.l_linenumber - n.l_linenumber) = 1 AND r.l_returnflag = 'R'
    WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = n.l_orderkey AND x.l_linenumber = n.l_linenumber AND x.l_returnflag = 'R')""")
def j13_neighbours(t: Tables) -> DataFrame:
    """Lines next to a target line that aren't targets. One shuffle: a window, not a self join."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(col("l_returnflag") == "R").alias("target"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 1)
    return lines.withColumn("near", F.bool_or("target").over(w)).filter("near AND NOT target").select("l_orderkey", "l_linenumber")


@query("""
    SELECT a.o_custkey, CASE WHEN b.o_custkey IS NULL THEN 1 WHEN a.p <> b.p THEN 2 ELSE 1 END::BIGINT AS version
    FROM (SELECT o_custkey, max(o_totalprice) AS p FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)""")
def j14_prior_versions(t: Tables) -> DataFrame:
    """Wanted rows with their earlier version, which goes up where the content differs."""
    both = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"), F.max(F.when(col("o_orderstatus") == "F", col("o_totalprice"))).alias("old"))
    return both.select("o_custkey", F.when(col("old").isNotNull() & (col("p") != col("old")), 2).otherwise(1).cast("long").alias("version"))


@query("""
    SELECT o_orderkey, abs(o_totalprice - coalesce(s, 0)) < o_totalprice AS within, s IS NULL AS missing
    FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def j15_budget_check(t: Tables) -> DataFrame:
    """What was planned against what was used, one to one."""
    used = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    within = F.abs(col("o_totalprice") - F.coalesce("s", F.lit(0))) < col("o_totalprice")
    return t.orders.join(used, col("o_orderkey") == col("l_orderkey"), "left").select("o_orderkey", within.alias("within"), col("s").isNull().alias("missing"))


@query("""
    WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), x AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM a),
    b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role <> 'user')
    SELECT coalesce(x.conv_id, b.conv_id) AS conv_id, count(*) FILTER (WHERE x.text = b.text) AS equal, count(*) FILTER (WHERE x.text IS NULL OR b.text IS NULL OR x.text <> b.text) AS different
    FROM x FULL JOIN b ON x.conv_id = b.conv_id AND x.pos = b.pos GROUP BY 1""")
def j16_positional(t: Tables) -> DataFrame:
    """Two lists compared place by place, with what one of them has more."""
    side = lambda cond, name: t.conversations.filter(cond).select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("pos"), col("text").alias(name))
    both = side("role = 'user'", "x").join(side("role <> 'user'", "y"), ["conv_id", "pos"], "full")
    return both.groupBy("conv_id").agg(F.count_if(col("x") == col("y")).alias("equal"), F.count_if(~F.coalesce(col("x") == col("y"), F.lit(False))).alias("different"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def tk1_queue_head(t: Tables) -> DataFrame:
    """The first finalized one in order; unfinished ones count only where there is none."""
    done = col("o_orderstatus") == "F"
    return t.orders.orderBy(F.when(done, 0).otherwise(1), "o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("""
    SELECT event_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS seq FROM events) WHERE seq > 5 AND seq <= 37""")
def tk2_event_page(t: Tables) -> DataFrame:
    """A page of 32 events after a cursor, for each user."""
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t.events.select("event_id", seq.alias("seq")).filter("seq > 5 AND seq <= 37")


@query("""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    SELECT doc_id, rnk::BIGINT AS rnk, substr(line, 1, 160) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, pos) AS rnk FROM lines) WHERE rnk <= 4""")
def tk3_top4_excerpts(t: Tables) -> DataFrame:
    """The four longest lines of each document, cut to 160 characters; ties go by place. In the row."""
    ranked = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((-F.length(x)).alias("k"), i.alias("i"), F.substring(x, 1, 160).alias("x")))
    top = t.documents.select("doc_id", F.posexplode(F.slice(F.array_sort(ranked), 1, 4)).alias("r", "x"))
    return top.select("doc_id", (col("r") + 1).cast("long").alias("rnk"), col("x.x").alias("excerpt"))


@query("""
    SELECT user_id, event_type, last_seq::BIGINT AS last_seq, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seq DESC) AS place FROM
    (SELECT user_id, event_type, max(seq) AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1, 2)) WHERE place <= 3""")
def tk4_recent_distinct(t: Tables) -> DataFrame:
    """The most recent distinct messages of each key."""
    seqs = t.events.select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    last = seqs.groupBy("user_id", "event_type").agg(F.max("seq").cast("long").alias("last_seq"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("last_seq")))
    return last.withColumn("place", place.cast("long")).filter("place <= 3")


@query("""
    SELECT conv_id, array_to_string(list_distinct_first, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first_turn) AS list_distinct_first FROM
    (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1)""")
def so1_ordered_union(t: Tables) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return lists.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda s: s["role"])), ",").alias("roles"))


@query("""
    SELECT k, src FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src) AS r FROM (SELECT c_custkey AS k, 1 AS src FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, 2 FROM supplier)) WHERE r = 1""")
def so2_first_wins(t: Tables) -> DataFrame:
    """A union by key in which the first source wins."""
    both = t.customer.filter("c_acctbal > 5000").select(col("c_custkey").alias("k"), F.lit(1).alias("src")).unionByName(t.supplier.select(col("s_suppkey").alias("k"), F.lit(2).alias("src")))
    return both.groupBy("k").agg(F.min("src").alias("src"))


@query("""
    SELECT user_id, event_type, min(seq)::BIGINT AS first_seq, arg_max(value, seq) AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1, 2""")
def so3_distinct_keyed(t: Tables) -> DataFrame:
    """For each key its first place and its last value."""
    seqs = t.events.select("user_id", "event_type", "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    return seqs.groupBy("user_id", "event_type").agg(F.min("seq").cast("long").alias("first_seq"), F.max_by("value", "seq").alias("last_value"))


@query("""
    SELECT o_custkey, len(list_intersect(f, o)) > 0 AS overlap, list_has_all(o, f) AS covered FROM
    (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS f, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'F'), []) AS o FROM orders GROUP BY 1)""")
def so4_set_relations(t: Tables) -> DataFrame:
    """Whether two sets of a key meet, and whether one covers the other."""
    final = F.collect_set(F.when(col("o_orderstatus") == "F", col("o_orderpriority")))
    other = F.collect_set(F.when(col("o_orderstatus") != "F", col("o_orderpriority")))
    sets = t.orders.groupBy("o_custkey").agg(final.alias("f"), other.alias("o"))
    return sets.select("o_custkey", F.arrays_overlap("f", "o").alias("overlap"), (F.size(F.array_except("f", "o")) == 0).alias("covered"))


@query("""
    SELECT o_orderkey, count(l_linenumber) = count(DISTINCT l_linenumber) AND count(l_linenumber) > 0 AND bool_and(coalesce(l_suppkey IN (SELECT s_suppkey FROM supplier), false)) AS ok
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def so5_order_subset(t: Tables) -> DataFrame:
    """Whether an order's parts are there, unique and all known."""
    known = t.lineitem.join(t.supplier.select("s_suppkey"), col("l_suppkey") == col("s_suppkey"), "left")
    sums = known.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.size(F.collect_set("l_linenumber")).alias("k"), F.bool_and(col("s_suppkey").isNotNull()).alias("all"))
    ok = F.coalesce((col("n") == col("k")) & col("all"), F.lit(False))
    return t.orders.join(sums, col("o_orderkey") == col("l_orderkey"), "left").select("o_orderkey", ok.alias("ok"))


@query("""
    SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS added, b.k IS NULL AS removed FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
    FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def so6_name_difference(t: Tables) -> DataFrame:
    """What only one of two sets has. One aggregate in place of a full join."""
    sides = t.orders.groupBy(col("o_custkey").alias("k")).agg(F.bool_or(col("o_orderstatus") == "F").alias("a"), F.bool_or(col("o_orderstatus") == "O").alias("b"))
    return sides.filter("a <> b").select("k", (~col("a")).alias("added"), (~col("b")).alias("removed"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'replaced' ELSE 'kept' END AS part FROM conversations WHERE role IS NOT NULL""")
def so9_tail_replace(t: Tables) -> DataFrame:
    """All but the last block stay; the last is what an update replaces."""
    last = F.max("turn").over(W.partitionBy("conv_id"))
    return t.conversations.filter("role IS NOT NULL").select("conv_id", "turn", F.when(col("turn") == last, "replaced").otherwise("kept").alias("part"))


@query("SELECT user_id, count(DISTINCT event_id) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events) GROUP BY user_id")
def st1_receipts(t: Tables) -> DataFrame:
    """Deliveries counted once for each receipt key, with everything delivered twice."""
    e = t.events.select("user_id", "event_id")
    return e.unionAll(e).dropDuplicates(["user_id", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT user_id, event_type, value > 50 AS big, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq FROM events)
    SELECT user_id, event_type, 1 + sum(CASE WHEN p IS NOT NULL AND p <> big THEN 1 ELSE 0 END)::BIGINT AS version FROM (SELECT *, lag(big) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS p FROM s) GROUP BY 1, 2""")
def st3_versions(t: Tables) -> DataFrame:
    """Version: one, and one more for each change along the order."""
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    big = col("value") > 50
    changes = t.events.select("user_id", "event_type", (big != F.lag(big).over(w)).alias("c"))
    return changes.groupBy("user_id", "event_type").agg((F.count_if("c") + 1).alias("version"))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def st5_progress_on_change(t: Tables) -> DataFrame:
    """Rows that differ from the one before."""
    p = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "event_type", p.alias("p")).filter(~col("event_type").eqNullSafe(col("p"))).select("event_id")


@query("""
    WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), f AS (SELECT user_id, min(seq) FILTER (WHERE event_type = 'purchase') AS e, max(seq) AS m FROM s GROUP BY 1)
    SELECT user_id, coalesce(e, m)::BIGINT AS cursor, e IS NOT NULL AS terminal FROM f""")
def st8_reducer_last(t: Tables) -> DataFrame:
    """Where a reader's cursor stops: at the first terminal event, else at the last."""
    seqs = t.events.select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    ends = seqs.groupBy("user_id").agg(F.min(F.when(col("event_type") == "purchase", col("seq"))).alias("e"), F.max("seq").alias("m"))
    return ends.select("user_id", F.coalesce("e", "m").cast("long").alias("cursor"), col("e").isNotNull().alias("terminal"))


@query("SELECT p_partkey, regexp_full_match(p_brand, '[A-Za-z0-9][A-Za-z0-9_.-]{0,127}') AS ok, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_.-]{0,127}') AS name_ok FROM part")
def pf6_valid_id(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.valid_id(col("p_brand")).alias("ok"), T.valid_id(col("p_name")).alias("name_ok"))


@query("SELECT conv_id, turn::BIGINT AS block_id, role, text FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def pf1_public_blocks(t: Tables) -> DataFrame:
    """Public fields of blocks, numbered anew."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long") - 1
    return t.conversations.select("conv_id", n.alias("block_id"), "role", "text")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(text) <> '' AND turn >= 0")
def pf3_eligible(t: Tables) -> DataFrame:
    """Blocks that count as history."""
    return t.conversations.filter((col("role") == "user") & (F.trim("text") != "") & (col("turn") >= 0)).select("conv_id", "turn")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'VALIDATING' WHEN 'O' THEN 'OCR' ELSE 'ASSEMBLING' END AS status FROM orders")
def pf5_status_map(t: Tables) -> DataFrame:
    states = F.create_map(F.lit("F"), F.lit("VALIDATING"), F.lit("O"), F.lit("OCR"))
    return t.orders.select("o_orderkey", F.coalesce(states[col("o_orderstatus")], F.lit("ASSEMBLING")).alias("status"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'the ') ORDER BY doc_id LIMIT 3")
def pf7_search_first3(t: Tables) -> DataFrame:
    """The first three hits of a search."""
    return t.documents.filter(col("text").contains("the ")).select("doc_id").orderBy("doc_id").limit(3)


@query("SELECT pos::BIGINT AS pos, c_custkey, c_name FROM (VALUES (0, 7), (1, 3), (2, 5)) v(pos, k) JOIN customer ON c_custkey = k")
def pf8_point_lookup(t: Tables) -> DataFrame:
    """Rows by key, with the place that each had in the request."""
    asked = t.spark.createDataFrame([([7, 3, 5],)], "k array<long>").select(F.posexplode("k").alias("pos", "k"))
    return t.customer.join(asked, col("c_custkey") == col("k")).select(col("pos").cast("long").alias("pos"), "c_custkey", "c_name")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS pos FROM customer WHERE contains(lower(c_name), lower(trim('  R#000000 '))) OR contains(lower(c_mktsegment), 'build') QUALIFY pos <= 50")
def pf9_visible(t: Tables) -> DataFrame:
    """Visible tasks by a trimmed search that ignores case, newest first: a page of fifty."""
    hit = F.lower("c_name").contains("r#000000") | F.lower("c_mktsegment").contains("build")
    page = t.customer.filter(hit).select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    return page.select("c_custkey", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("pos"))


@query("""
    SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FAILED' WHEN o_custkey % 50 = 0 THEN 'NOT_CONNECTED' WHEN bool_or(coalesce(l_linestatus = 'O', false)) AND bool_or(coalesce(l_linestatus = 'F', false)) THEN 'UPLOADING'
    WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN count(l_orderkey) > 0 THEN 'PROCESSING' ELSE 'IDLE' END AS display_status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus""")
def pf10_display_status(t: Tables) -> DataFrame:
    """A cascade of statuses over an order and its lines."""
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.bool_or(col("l_returnflag") == "R").alias("failed"), F.bool_or(col("l_linestatus") == "O").alias("some_open"), F.bool_or(col("l_linestatus") == "F").alias("some_done")
    )
    status = (
        F.when(col("failed"), "FAILED").when(col("o_custkey") % 50 == 0, "NOT_CONNECTED").when(col("some_open") & col("some_done"), "UPLOADING")
        .when(col("o_orderstatus") == "F", "COMPLETED").when(col("failed").isNotNull(), "PROCESSING").otherwise("IDLE")
    )
    return t.orders.join(lines, col("o_orderkey") == col("l_orderkey"), "left").select("o_orderkey", status.alias("display_status"))


@query("SELECT o_orderkey, o_orderkey % 700 IN (408, 429) OR o_orderkey % 700 >= 500 AS transient FROM orders")
def pf11_transient(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.transient_error(F.lit(None).cast("string"), col("o_orderkey") % 700).alias("transient"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) < 3 AS admitted FROM orders GROUP BY 1")
def pf12_capture_admission(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg((F.count_if(col("o_orderstatus").isin("O", "P")) < 3).alias("admitted"))


@query("SELECT c_custkey, count(o_orderkey) > 0 AND coalesce(bool_and(o_orderstatus IN ('F', 'O')), false) AS may_finish FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def pf13_finish_gate(t: Tables) -> DataFrame:
    """There is one at least and all are in a state that allows it."""
    states = t.orders.groupBy("o_custkey").agg(F.bool_and(col("o_orderstatus").isin("F", "O")).alias("ok"))
    return t.customer.join(states, col("c_custkey") == col("o_custkey"), "left").select("c_custkey", F.coalesce("ok", F.lit(False)).alias("may_finish"))


@query("SELECT s_suppkey FROM supplier WHERE sha256(s_name) IN (SELECT sha256('Supplier#000000001') UNION SELECT sha256(s_name) FROM supplier WHERE s_suppkey = 2) AND s_acctbal IS NOT NULL")
def pf14_token_filter(t: Tables) -> DataFrame:
    """Rows whose digest is one of the valid ones and which aren't revoked."""
    valid = t.supplier.filter((col("s_suppkey") == 2) | (col("s_name") == "Supplier#000000001")).select(T.sha256(col("s_name")).alias("d")).distinct()
    own = t.supplier.filter("s_acctbal IS NOT NULL").withColumn("own", T.sha256(col("s_name")))
    return own.join(valid, col("own") == col("d"), "left_semi").select("s_suppkey")


@query("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'TOO_LARGE' WHEN k > 1 AND o_orderpriority = '1-URGENT' THEN 'DUPLICATE' WHEN o_orderstatus = 'F' THEN 'FROZEN' WHEN n > 20 THEN 'TOO_MANY' END AS code
    FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def pf15_admission(t: Tables) -> DataFrame:
    """The first rule that an upload breaks, null if none. Both counts share one shuffle."""
    n = W.partitionBy("o_custkey")
    counted = t.orders.withColumn("n", F.count("*").over(n)).withColumn("k", F.sum(F.when(col("o_orderpriority") == "1-URGENT", 1)).over(n))
    code = F.coalesce(
        F.when(col("o_totalprice") > 400000, "TOO_LARGE"), F.when((col("o_orderpriority") == "1-URGENT") & (col("k") > 1), "DUPLICATE"),
        F.when(col("o_orderstatus") == "F", "FROZEN"), F.when(col("n") > 20, "TOO_MANY"),
    )
    return counted.select("o_orderkey", code.alias("code"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#@ ]+([/?#].*)?$') AS safe FROM pages")
def pf16_safe_link(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.safe_link(col("url")).alias("safe"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/?#@ ]+(/[^?#]*)?$') THEN regexp_replace(url, '/+$', '') END AS base FROM pages")
def pf17_service_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.service_url(col("url")).alias("base"))


@query("""
    SELECT o_orderstatus AS image_id, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS repairs, count(*) AS requests, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS codes FROM orders GROUP BY 1""")
def ag4_repair_stats(t: Tables) -> DataFrame:
    """Repairs, requests and codes of each image."""
    return t.orders.groupBy(col("o_orderstatus").alias("image_id")).agg(
        F.count_if(col("o_orderpriority") == "1-URGENT").alias("repairs"), F.count("*").alias("requests"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("codes")
    )


@query("""
    SELECT lang, coalesce(bool_or(quality = 0), false) OR bool_or(n_chars < 20) AS needs_review FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY lang""")
def ag6_review(t: Tables) -> DataFrame:
    """Whether any member needs a review; unknown doesn't count."""
    marks = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = t.documents.select("doc_id", "lang", "n_chars").join(marks, "doc_id", "left")
    return joined.groupBy("lang").agg((F.coalesce(F.bool_or(col("quality") == 0), F.lit(False)) | F.bool_or(col("n_chars") < 20)).alias("needs_review"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'P') THEN 'unavailable' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'complete' END AS xml_status FROM orders GROUP BY 1")
def ag7_holes(t: Tables) -> DataFrame:
    hole = col("o_orderstatus") == "P"
    return t.orders.groupBy("o_custkey").agg(F.when(F.bool_and(hole), "unavailable").when(F.bool_or(hole), "partial").otherwise("complete").alias("xml_status"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'P') AS batches, count(*) AS total FROM orders GROUP BY 1")
def ag8_progress(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count_if(col("o_orderstatus") == "F").alias("done"), F.count_if(col("o_orderstatus") != "P").alias("batches"), F.count("*").alias("total"))


@query("SELECT count(DISTINCT o_custkey) AS active, count(*) AS uploads, coalesce(sum(o_shippriority_bytes), 0)::BIGINT AS reserved FROM (SELECT *, round(o_totalprice)::BIGINT AS o_shippriority_bytes FROM orders WHERE o_orderstatus = 'P')")
def ag9_capacity(t: Tables) -> DataFrame:
    p = t.orders.filter("o_orderstatus = 'P'")
    return p.agg(F.countDistinct("o_custkey").alias("active"), F.count("*").alias("uploads"), F.coalesce(F.sum(F.round("o_totalprice").cast("long")), F.lit(0)).alias("reserved"))


@query("""
    SELECT user_id, arg_min(value, seq) AS first_v, arg_max(value, seq) AS last_v, max(value) AS peak_v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1""")
def ag10_peak_summary(t: Tables) -> DataFrame:
    """First, last and largest reading. Ordered aggregates in place of a window."""
    at = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.min_by("value", at).alias("first_v"), F.max_by("value", at).alias("last_v"), F.max("value").alias("peak_v"), F.count("*").alias("n"))


@query("""
    SELECT user_id, arg_min(value, seq) AS first_v, arg_max(value, seq) AS last_v, max(value) AS peak_v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq >= 4 GROUP BY 1""")
def ag11_window_summary(t: Tables) -> DataFrame:
    """The same from a sample's place on."""
    seqs = t.events.select("user_id", "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq")).filter("seq >= 4")
    return seqs.groupBy("user_id").agg(F.min_by("value", "seq").alias("first_v"), F.max_by("value", "seq").alias("last_v"), F.max("value").alias("peak_v"), F.count("*").alias("n"))


@query("SELECT event_type, max(value) AS max_v, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def ag12_latency(t: Tables) -> DataFrame:
    """Largest value, median and nearest-rank 95th percentile."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return t.events.groupBy("event_type").agg(F.max("value").alias("max_v"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query(r"""
    SELECT conv_id, sum(length(regexp_replace(text, '\s', '', 'g')))::BIGINT AS word_count, coalesce(arg_min(text, turn) FILTER (WHERE role = 'system' AND trim(text) <> ''), arg_min(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), 'untitled') AS title
    FROM conversations GROUP BY 1""")
def ag13_count_and_title(t: Tables) -> DataFrame:
    """Characters that aren't white space, and the first title, else the first heading."""
    filled = F.trim("text") != ""
    first = lambda role: F.min_by(F.when((col("role") == role) & filled, col("text")), F.when((col("role") == role) & filled, col("turn")))
    return t.conversations.groupBy("conv_id").agg(F.sum(T.nonspace_count(col("text"))).alias("word_count"), F.coalesce(first("system"), first("user"), F.lit("untitled")).alias("title"))


@query("SELECT l_partkey, count(*) AS claims FROM lineitem GROUP BY 1")
def ag14_claim_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("claims"))


@query("SELECT doc_id, CASE WHEN n_chars % 97 = 0 THEN NULL ELSE round(n_chars / (n_chars % 97), 3) END AS per_second FROM documents")
def ag15_rate(t: Tables) -> DataFrame:
    """Tokens a second, to three places; null without time."""
    s = col("n_chars") % 97
    return t.documents.select("doc_id", F.when(s != 0, F.round(col("n_chars") / s, 3)).alias("per_second"))


@query("SELECT o_orderstatus AS batch, sum(k)::BIGINT AS calls, count(*) FILTER (WHERE k > 3) AS selections, count(*) FILTER (WHERE k <= 3) AS declines FROM orders JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def ag16_option_sums(t: Tables) -> DataFrame:
    calls = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    joined = t.orders.join(calls, col("o_orderkey") == col("l_orderkey"))
    return joined.groupBy(col("o_orderstatus").alias("batch")).agg(F.sum("k").alias("calls"), F.count_if(col("k") > 3).alias("selections"), F.count_if(col("k") <= 3).alias("declines"))


@query("""
    SELECT user_id, max(open_now)::BIGINT AS most, max(open_now) > 2 AS over_cap FROM (SELECT user_id, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open_now FROM events) GROUP BY 1""")
def ag17_connections(t: Tables) -> DataFrame:
    """The most connections that were open at a time, from openings and closings."""
    step = F.when(col("event_type").isin("click", "view"), 1).otherwise(-1)
    now = t.events.select("user_id", F.sum(step).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("x"))
    return now.groupBy("user_id").agg(F.max("x").cast("long").alias("most"), (F.max("x") > 2).alias("over_cap"))


@query(r"""
    SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t]*[\r\n]+[ \t]*', '', 'g'), '\t', '', 'g')) AS h, length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS n FROM documents""")
def sf1_structural_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.sha256(T.structural_text(col("text"))).alias("h"), T.nonspace_count(col("text")).cast("long").alias("n"))


@query("SELECT conv_id, turn, 'h' || turn || 'v1:' || sha256(text) AS history_ref FROM conversations")
def sf11_history_ref(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.concat(F.lit("h"), col("turn").cast("string"), F.lit("v1:"), T.sha256(col("text"))).alias("history_ref"))


@query("SELECT p_partkey, (2 * p_size * 4 * 6 // 4)::BIGINT AS tokens FROM part")
def sf13_image_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.image_tokens(F.lit(1), col("p_size").cast("long") * 2, F.lit(24), 2).alias("tokens"))


@query("""
    SELECT p_partkey, CASE WHEN greatest(w, h) <= 1280 THEN w ELSE greatest(1, floor(w * (1280.0::DOUBLE / greatest(w, h)) + 0.5)) END::BIGINT AS w, CASE WHEN greatest(w, h) <= 1280 THEN h ELSE greatest(1, floor(h * (1280.0::DOUBLE / greatest(w, h)) + 0.5)) END::BIGINT AS h
    FROM (SELECT p_partkey, p_size * 83 AS w, (p_partkey % 4000) + 1 AS h FROM part)""")
def sf14_target_size(t: Tables) -> DataFrame:
    w, h = T.target_size(col("p_size") * 83, col("p_partkey") % 4000 + 1, 1280)
    return t.part.select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT doc_id, least(8192, 16384 - n_chars - 512) AS budget, least(8192, 16384 - n_chars - 512) >= 512 AS fits FROM documents")
def sf15_budget(t: Tables) -> DataFrame:
    budget = T.output_budget(col("n_chars"))
    return t.documents.select("doc_id", budget.alias("budget"), (budget >= 512).alias("fits"))


@query("SELECT doc_id, n_chars + 8192 <= 16384 AS fits FROM documents")
def sf16_context_fits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.context_fits(col("n_chars"), F.lit(8192), F.lit(16384)).alias("fits"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM pages")
def sf19_html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.sha256(T.escaped(col("html"))).alias("h"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR n < CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END THEN o_orderstatus ELSE CASE n WHEN 0 THEN 'O' WHEN 1 THEN 'P' ELSE 'F' END END AS state
    FROM (SELECT *, o_orderkey % 3 AS n FROM orders)""")
def sf21_state_advance(t: Tables) -> DataFrame:
    """States only go on, and the last stays."""
    new = F.element_at(F.array(F.lit("O"), F.lit("P"), F.lit("F")), (col("o_orderkey") % 3 + 1).cast("int"))
    return t.orders.select("o_orderkey", T.advanced_state(col("o_orderstatus"), new, ["O", "P", "F"], ["F"]).alias("state"))


@query("SELECT doc_id, text = trim(text) AS exact, CASE WHEN text = '' THEN NULL ELSE regexp_replace(text, '\\s', '', 'g') = regexp_replace(lower(text), '\\s', '', 'g') END AS normalized FROM documents")
def sf22_text_equality(t: Tables) -> DataFrame:
    same = T.stripped(col("text")) == T.stripped(F.lower("text"))
    return t.documents.select("doc_id", (col("text") == F.trim("text")).alias("exact"), F.when(col("text") != "", same).alias("normalized"))


@query("SELECT user_id, least(30, 2 ** (user_id % 9))::BIGINT AS wait_s FROM events GROUP BY user_id")
def st11_backoff(t: Tables) -> DataFrame:
    return t.events.select("user_id").distinct().select("user_id", T.backoff_seconds(col("user_id") % 9).alias("wait_s"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_totalprice < 1000 THEN 'BLOCKED' WHEN o_orderpriority = '1-URGENT' THEN 'RETRY' ELSE 'WAITING' END AS step FROM orders""")
def st15_sync_step(t: Tables) -> DataFrame:
    """What a client's next step of synchronisation is."""
    step = F.when(col("o_orderstatus") == "F", "DONE").when(col("o_totalprice") < 1000, "BLOCKED").when(col("o_orderpriority") == "1-URGENT", "RETRY").otherwise("WAITING")
    return t.orders.select("o_orderkey", step.alias("step"))


@query("SELECT conv_id, turn FROM conversations c WHERE turn >= (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id AND m.role = 'user')")
def st10_generation(t: Tables) -> DataFrame:
    """Only what the newest session sent counts."""
    newest = F.max(F.when(col("role") == "user", col("turn"))).over(W.partitionBy("conv_id"))
    return t.conversations.withColumn("g", newest).filter("turn >= g").select("conv_id", "turn")


@query("SELECT user_id, least(3, count(*) FILTER (WHERE event_type = 'error' OR value < 10))::BIGINT AS attempts, count(*) FILTER (WHERE event_type = 'error' OR value < 10) >= 3 AS spent FROM events GROUP BY 1")
def st16_retry_budget(t: Tables) -> DataFrame:
    n = F.count_if((col("event_type") == "error") | (col("value") < 10))
    return t.events.groupBy("user_id").agg(F.least(F.lit(3), n).cast("long").alias("attempts"), (n >= 3).alias("spent"))


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS suffix_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AND sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1536")
def wf4_suffix_budget(t: Tables) -> DataFrame:
    """The last three blocks that fit a budget together, from the end."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.conversations.select("conv_id", "turn", F.length("text").alias("k"), F.row_number().over(w).alias("r")).filter("r <= 3")
    return last.withColumn("suffix_chars", F.sum("k").over(w).cast("long")).filter("suffix_chars <= 1536").select("conv_id", "turn", "suffix_chars")


@query("""
    SELECT o_custkey, min(s)::BIGINT AS lo, max(e)::BIGINT AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e) AS island FROM
    (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 2) + 1 THEN 1 ELSE 0 END AS new FROM (SELECT o_custkey, o_orderkey // 100 AS s, o_orderkey // 100 + o_orderkey % 7 AS e FROM orders))) GROUP BY o_custkey, island""")
def wf7_coalesced_intervals(t: Tables) -> DataFrame:
    """Intervals of a key put together where they touch."""
    w = W.partitionBy("o_custkey").orderBy("s", "e")
    rows = t.orders.select("o_custkey", F.floor(col("o_orderkey") / 100).alias("s"), (F.floor(col("o_orderkey") / 100) + col("o_orderkey") % 7).alias("e"))
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", (col("s") > F.coalesce(before, col("s") - 2) + 1).cast("int")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("o_custkey", "island").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).drop("island")


@query(r"SELECT conv_id, turn, repeat('`', greatest(3, coalesce(list_max([length(x) for x in regexp_extract_all(text, '`+')]), 0) + 1)) AS fence FROM conversations")
def sk9_fences(t: Tables) -> DataFrame:
    """A fence for each block of a report that no run of backticks in it closes."""
    return t.conversations.select("conv_id", "turn", T.fence(col("text")).alias("fence"))
