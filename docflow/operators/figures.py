"""Figures and set relations over the engine's tables: memory, delivery, words, claims, calls, feedback, orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def memory_summary(samples: DataFrame, since: int = 0) -> DataFrame:
    """``run_id, n, first, last, peak, peak_sample, baseline`` of ``samples`` (``run_id, sample, label, used``) from a sample on. The baseline is the reading labelled so, else the
    first one; of equal peaks the first counts."""
    kept = samples.filter(F.col("sample") >= since)
    named = F.min_by(F.when(F.col("label") == "baseline", F.col("used")), F.when(F.col("label") == "baseline", F.col("sample")))
    first = F.min_by("used", "sample")
    return kept.groupBy("run_id").agg(
        F.count("*").alias("n"), first.alias("first"), F.max_by("used", "sample").alias("last"), F.max("used").alias("peak"),
        F.max_by("sample", F.struct("used", -F.col("sample"))).alias("peak_sample"), F.coalesce(named, first).alias("baseline"),
    )


def delivery(events: DataFrame) -> DataFrame:
    """``document_id, n_live, most_ms, median_ms, p95_ms`` of events (``document_id, sent_ms, received_ms, replayed``): only those that weren't replayed count; percentiles
    by the nearest rank."""
    took = F.when(~F.col("replayed"), F.col("received_ms") - F.col("sent_ms"))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY took)")
    return events.select("document_id", took.alias("took")).groupBy("document_id").agg(F.count("took").alias("n_live"), F.max("took").alias("most_ms"), rank(0.5).alias("median_ms"), rank(0.95).alias("p95_ms"))


def words_and_title(blocks: DataFrame, otherwise: str = "untitled") -> DataFrame:
    """``document_id, n_words, title`` of blocks (``document_id, ord, xml, text``): characters that aren't white space, and the text of the first title, else of
    the first heading that isn't blank."""

    def first(tags: str) -> Column:
        wanted = F.col("xml").rlike(rf"^<{tags}[\s/>]") & (F.trim(F.coalesce("text", F.lit(""))) != "")
        return F.min_by(F.when(wanted, F.trim("text")), F.when(wanted, F.col("ord")))

    return blocks.groupBy("document_id").agg(F.sum(T.nonspace_count(F.coalesce("text", F.lit("")))).alias("n_words"), F.coalesce(first("title"), first("h[1-6]"), F.lit(otherwise)).alias("title"))


def claim_counts(blocks: DataFrame) -> DataFrame:
    """``document_id, ref, claims``: by how many blocks (``document_id, ord, ocr_refs``) each recognised line is claimed, a block counting once."""
    return blocks.select("document_id", "ord", F.explode(F.array_distinct("ocr_refs")).alias("ref")).groupBy("document_id", "ref").agg(F.count("*").alias("claims"))


def rate(tokens: Column, seconds: Column) -> Column:
    """Tokens a second to three places; null without time."""
    return F.when(seconds > 0, F.round(tokens / seconds, 3))


def call_sums(calls: DataFrame) -> DataFrame:
    """``document_id, image_id, repairs, applied, declined, per_second`` of calls (``document_id, image_id, kind, action, tokens, seconds``)."""
    count = lambda c, name: F.count_if(c).alias(name)
    return calls.groupBy("document_id", "image_id").agg(
        count(F.col("kind") == "repair", "repairs"), count(F.col("action") == "apply_repair_option", "applied"), count(F.col("action") == "decline_repair_option", "declined"),
        rate(F.sum("tokens"), F.sum("seconds")).alias("per_second"),
    )


def budgets(planned: DataFrame, used: DataFrame) -> DataFrame:
    """``call_id, known, matches, fits`` of planned calls (``call_id, inspected, most_output, context``) against what they used (``call_id, prompt_tokens,
    output_tokens``): whether there are figures, the prompt was as long as planned, and both stayed in their budget."""
    both = planned.join(used, "call_id", "left")
    known = F.col("prompt_tokens").isNotNull()
    fits = (F.col("output_tokens") <= F.col("most_output")) & (F.col("prompt_tokens") + F.col("output_tokens") <= F.col("context"))
    return both.select("call_id", known.alias("known"), F.coalesce(F.col("prompt_tokens") == F.col("inspected"), F.lit(False)).alias("matches"), F.coalesce(fits, F.lit(False)).alias("fits"))


def recent_feedback(messages: DataFrame, most: int = 12) -> DataFrame:
    """``document_id, place, message``: the last distinct messages (``document_id, seq, message``), in the order of their first occurrence."""
    seen = messages.groupBy("document_id", "message").agg(F.min("seq").alias("seq"))
    back, place = (F.row_number().over(W.partitionBy("document_id").orderBy(order)) for order in (F.desc("seq"), F.asc("seq")))
    return seen.filter("seq IS NOT NULL").withColumn("back", back).filter(F.col("back") <= most).withColumn("place", place - 1).select("document_id", "place", "message")


def distinct_errors(errors: DataFrame) -> DataFrame:
    """``document_id, code, message, seq, record``: one row for each code and message, at its first place and with its last record."""
    return errors.groupBy("document_id", "code", "message").agg(F.min("seq").alias("seq"), F.max_by("record", "seq").alias("record"))


def first_of_each(sources: list[DataFrame], key: str) -> DataFrame:
    """The rows of several tables of one shape by key: the first table that has a key gives its row (of rows that share it there, the least)."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)))
    rest = [c for c in rows.columns if c not in (key, "source")]
    return rows.groupBy(key).agg(F.min(F.struct("source", *rest)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in rest))


def ordered_union(lists: DataFrame) -> DataFrame:
    """``document_id, ids`` without repeats, in order of first occurrence, of ``document_id, place, ids`` (arrays)."""
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"]))
    return lists.groupBy("document_id").agg(F.array_distinct(every).alias("ids"))


def lineage_cover(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``document_id, disjoint, exact``: whether no two rows (``document_id, id, lineage``) share a first candidate, and whether together they have just those in ``roots``
    (``document_id, root``)."""
    each = rows.select("document_id", F.explode("lineage").alias("root")).groupBy("document_id", "root").agg(F.count("*").alias("n"))
    both = each.join(roots.select("document_id", "root", F.lit(True).alias("wanted")), ["document_id", "root"], "full")
    return both.groupBy("document_id").agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("disjoint"), F.bool_and(F.col("n").isNotNull() & F.col("wanted").isNotNull()).alias("exact"))


def sound_orders(orders: DataFrame, images: DataFrame) -> DataFrame:
    """``document_id, sound``: whether a document's final order (``document_id, ids``) isn't empty, has no id twice, and only ids of its images (``document_id, image_id``)."""
    asked = orders.select("document_id", F.explode_outer("ids").alias("image_id"))
    known = asked.join(images.select("document_id", "image_id").distinct().withColumn("there", F.lit(True)), ["document_id", "image_id"], "left")
    sums = known.groupBy("document_id").agg(F.count("image_id").alias("n"), F.count_distinct("image_id").alias("k"), F.bool_and(F.col("there").isNotNull()).alias("all"))
    return sums.select("document_id", ((F.col("n") > 0) & (F.col("n") == F.col("k")) & F.col("all")).alias("sound"))


def unregistered(files: DataFrame, registered: DataFrame) -> DataFrame:
    """Files (``document_id, path``) that no row of ``registered`` names: left over from uploads that weren't finished."""
    return files.join(registered.select("document_id", "path"), ["document_id", "path"], "left_anti")
