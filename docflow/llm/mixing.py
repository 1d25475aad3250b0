"""Mixing sources to target weights. DataFrame functions only.

Sources share all words by weight; none gets more than ``max_repeat`` times its own words, and
what it can't take is shared anew among the others by weight. A document of a source with rate
target / size is emitted floor(rate) times, and once more if a number seeded by its id falls
below the fraction.

Edge cases: a null or empty text has size 0 and is emitted by the same rule; a null source comes
last in order; repeated ids draw the same number; a source without words has target 0; an empty
table gives an empty one; further columns are carried by ``mix_documents`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import SPACES, has_columns, stored

SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words, without an array of them: runs of spaces become one, ends go."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", " ")
    bare = F.trim(flat)
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.translate(bare, " ", "")) + 1).cast("long")


def draw(id_: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    hexed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``; one row per source.

    target = least(cap, level * weight), where the level makes the targets add up to all words.
    The level of the first source that is not full counts (a later one is lower). In the order of cap / weight the sources below the level are full, so that the level follows
    from sums over that order. The windows run over one row per source, not over documents: in one
    task, which holds millions of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((rank - 1) % cycle + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "cap_before": F.coalesce(F.sum("cap").over(before), zero),
        "weight_before": F.coalesce(F.sum("weight").over(before), zero),
    })
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def copies(id_: Column, target: Column, source_size: Column, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(draw(id_, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of each row."""
    sizes = stored(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")),
        "mix-sizes",
    )
    per = targets(sizes).withColumnRenamed("source", "s")
    joined = sizes.join(per, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("target"), F.col("source_size"), seed))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is emitted, columns unchanged."""
    sizes = docs.select(F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    per = stored(targets(sizes), "mix-targets")
    # The row is one column and its source another, so that no name of the input can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("own"))
    joined = rows.join(per, F.col("own").eqNullSafe(F.col("source")), "left").withColumn("k", copies(F.col("id"), F.col("target"), F.col("source_size"), seed))
    return joined.filter("k > 0").select("row", F.explode(F.sequence(F.lit(1).cast(T.LongType()), F.col("k"))).alias("i")).select("row.*")


def op6_rows(docs: DataFrame) -> DataFrame:
    mixed = mix_table(has_columns(docs, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
