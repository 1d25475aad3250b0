"""Queries of alignment and retrieval over conversations, turns against others that they share parts with, and their SQL.

The SQL finds matching blocks by the rule itself: all diagonals on which two texts agree, the longest one within a range, and
so on to its left and right.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import align
from ..functions import text as T
from ..operators import blocks as B
from ..operators import overlap
from .relational import Tables, registry

QUERIES, ORACLES, query = registry()
col = F.col

#: From ``pairs`` (id, a, b) to ``matched`` (id, i, j, n): where the block is in either text, and its length.
BLOCKS = """
    ours AS (SELECT id, k AS i, a[k + 1] AS c FROM (SELECT id, a, unnest(range(length(a))) AS k FROM pairs)),
    other AS (SELECT id, k AS j, b[k + 1] AS c FROM (SELECT id, b, unnest(range(length(b))) AS k FROM pairs)),
    equal AS (SELECT id, i, i - j AS d, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM ours JOIN other USING (id, c)),
    diagonals AS (SELECT id, d, min(i) AS i, count(*) AS n FROM equal GROUP BY id, d, g),
    ranges AS (
        SELECT id, 0::BIGINT AS a1, length(a)::BIGINT AS a2, 0::BIGINT AS b1, length(b)::BIGINT AS b2, (SELECT max(row(n, -i, d - i)) FROM diagonals x WHERE x.id = pairs.id) AS m FROM pairs
        UNION ALL
        SELECT id, a1, a2, b1, b2, max(row(least(i + n, a2, b2 + d) - greatest(i, a1, b1 + d), -greatest(i, a1, b1 + d), d - greatest(i, a1, b1 + d))) FROM (
            SELECT id, CASE side WHEN 0 THEN a1 ELSE m[1] - m[2] END AS a1, CASE side WHEN 0 THEN -m[2] ELSE a2 END AS a2, CASE side WHEN 0 THEN b1 ELSE m[1] - m[3] END AS b1, CASE side WHEN 0 THEN -m[3] ELSE b2 END AS b2 FROM ranges, (VALUES (0), (1)) s(side) WHERE m[1] > 0)
        JOIN diagonals USING (id) WHERE least(i + n, a2, b2 + d) > greatest(i, a1, b1 + d) GROUP BY 1, 2, 3, 4, 5),
    matched AS (SELECT id, -m[2] AS i, -m[3] AS j, m[1] AS n FROM ranges WHERE m[1] > 0)"""

#: Each turn and the one before, without white space.
NEIGHBOURS = r"""WITH RECURSIVE texts AS (SELECT conv_id, turn, regexp_replace(text, '\s+', '', 'g') AS s FROM conversations),
    pairs AS (SELECT row(conv_id, turn) AS id, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS a, s AS b FROM texts QUALIFY a IS NOT NULL),""" + BLOCKS


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), col("turn").cast("int").alias("ord"), "text")


def neighbours(t: Tables) -> DataFrame:
    before = F.lag("text").over(W.partitionBy("document_id").orderBy("ord"))
    return turns(t).withColumn("before", before).filter("before IS NOT NULL")


@query(f"""{NEIGHBOURS}
    SELECT id[1]::VARCHAR AS document_id, id[2]::INT AS ord, coalesce(sum(n), 0)::BIGINT AS matched, CASE WHEN a <> '' THEN coalesce(sum(n), 0) / length(a) END AS coverage, CASE WHEN b <> '' THEN coalesce(sum(n), 0) / length(b) END AS support
    FROM pairs LEFT JOIN matched USING (id) GROUP BY id, a, b""")
def dm8_alignment_turns(t: Tables) -> DataFrame:
    """Each turn aligned with the one before."""
    return B.aligned(neighbours(t), "before", "text").select("document_id", "ord", "matched", "coverage", "support")


@query(f"""{NEIGHBOURS}, totals AS (SELECT id, a, b, coalesce(sum(n), 0) AS m FROM pairs LEFT JOIN matched USING (id) GROUP BY id, a, b),
    ends AS (SELECT id, i AS s, n FROM matched UNION ALL SELECT id, length(a), 0 FROM pairs),
    gaps AS (SELECT id, s, coalesce(lag(s + n) OVER (PARTITION BY id ORDER BY s, n DESC), 0) AS e FROM ends),
    missing AS (SELECT id, list(substr(a, e + 1, least(s - e, 160)) ORDER BY s - e DESC, e)[:4] AS missing FROM gaps JOIN pairs USING (id) WHERE s > e GROUP BY id)
    SELECT id[1]::VARCHAR AS document_id, id[2]::INT AS ord, round_even(CASE WHEN a <> '' THEN m / length(a) ELSE 1 END, 6) AS source_coverage, round_even(CASE WHEN b <> '' THEN m / length(b) ELSE 0 END, 6) AS output_support, coalesce(missing, []) AS missing,
        CASE WHEN least(CASE WHEN a <> '' THEN m / length(a) ELSE 1 END, CASE WHEN b <> '' THEN m / length(b) ELSE 0 END) < 0.8 THEN ['CONTENT_MISMATCH'] ELSE [] END AS errors FROM totals LEFT JOIN missing USING (id)""")
def dm9_uncovered_turns(t: Tables) -> DataFrame:
    """How well each turn covers the one before, and the longest parts of that which it lacks."""

    @F.pandas_udf("source_coverage double, output_support double, missing array<string>, errors array<string>")
    def checked(update: pd.Series, source: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align.content_checks([(u, None, s) for u, s in zip(update, source, strict=True)]))[["source_coverage", "output_support", "missing", "errors"]]

    return neighbours(t).select("document_id", "ord", checked(T.update(T.paragraph(col("text"))), "before").alias("c")).select("document_id", "ord", "c.*")


#: One query a conversation: sixty characters from the middle of each second turn, in capitals and spread out.
ASKED = r"""WITH RECURSIVE rows AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations),
    folded AS (SELECT conv_id, ord, replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss') AS s FROM rows),
    asked AS (SELECT conv_id, replace(lower(regexp_replace(string_agg(substr(text, length(text) // 3 + 1, 60), ' -' ORDER BY ord), '\s+', '', 'g')), 'ß', 'ss') AS q FROM rows WHERE ord % 2 = 0 GROUP BY 1),
    pairs AS (SELECT row(conv_id, ord) AS id, s AS a, q AS b FROM folded JOIN asked USING (conv_id)),""" + BLOCKS + """,
    scores AS (SELECT id[1] AS conv_id, id[2] AS ord, CASE WHEN max(n) >= 12 THEN sum(n) / length(any_value(a)) ELSE 0 END AS score FROM pairs JOIN matched USING (id) GROUP BY id)"""


def placed(t: Tables) -> DataFrame:
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select(col("conv_id").cast("string").alias("document_id"), place.alias("ord"), "role", "text")


def asking(rows: DataFrame) -> DataFrame:
    part = F.substring("text", F.expr("length(text) div 3 + 1"), F.lit(60))
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"))))
    spread = F.array_join(F.transform("p", lambda x: x["part"]), " -")
    return rows.filter("ord % 2 = 0").groupBy("document_id").agg(parts.alias("p")).select("document_id", F.lit("q").alias("query_id"), F.upper(spread).alias("text"))


@query(f"""{ASKED}
    SELECT conv_id::VARCHAR AS document_id, ord::INT AS ord, round(score, 6) AS score FROM scores WHERE score > 0""")
def j6_partial_similarity(t: Tables) -> DataFrame:
    """Blocks against a query that has parts of half of them: those that share twelve characters in sequence."""
    rows = placed(t)
    found = overlap.similarities(rows, asking(rows).withColumnRenamed("text", "query"))
    return found.select("document_id", "ord", F.round("score", 6).alias("score"))


@query(f"""{ASKED}, runs AS (SELECT conv_id, ord, count(*) FILTER (WHERE ord % 5 = 3) OVER (PARTITION BY conv_id ORDER BY ord) AS run, ord % 5 = 3 OR trim(text) = '' AS out FROM rows),
    kept AS (SELECT conv_id, ord, run, coalesce(score, 0) AS score, count(*) OVER (PARTITION BY conv_id, run) AS size FROM runs LEFT JOIN scores USING (conv_id, ord) WHERE NOT out),
    sums AS (SELECT conv_id, ord, least(size, 2) AS width, score + CASE WHEN size > 1 THEN lead(score) OVER (PARTITION BY conv_id, run ORDER BY ord) ELSE 0 END AS total FROM kept)
    SELECT conv_id::VARCHAR AS document_id, (max(row(total, ord, width))[2])::INT AS first_ord, (max(row(total, ord, width))[3])::INT AS n_blocks, round(max(total), 6) AS score FROM sums WHERE total > 0 GROUP BY 1""")
def dm10_partial_window(t: Tables) -> DataFrame:
    """The window of two blocks, in which each fifth one stands apart, that a query resembles most."""
    rows = placed(t)
    history = rows.select("document_id", "ord", F.lit("i").alias("image_id"), F.when(col("ord") % 5 == 3, "unresolved").otherwise("ok").alias("status"), "text")
    return overlap.retrieve(history, asking(rows), limit=2).select("document_id", "first_ord", "n_blocks", "score")
