"""The read-only evaluation of a finished document set: named checks, per-image figures, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from . import blocks as B


def duplicate_blocks(blocks: DataFrame, least: int = 80) -> DataFrame:
    """Groups of blocks whose texts are equal once white space is gone."""
    keyed = blocks.withColumn("key", T.stripped(F.col("text"))).filter(F.length("key") >= least)
    digests = keyed.select("document_id", "ord", F.sha2("key", 256).alias("k"), F.sha2("text", 256).alias("own"), F.length("key").alias("n"))
    groups = digests.groupBy("document_id", "k").agg(
        F.array_sort(F.collect_list("ord")).alias("block_ids"), F.max("n").alias("normalized_characters"), (F.min("own") == F.max("own")).alias("byte_identical")
    )
    return groups.filter(F.size("block_ids") > 1).drop("k")


def verification(blocks: DataFrame, exported: DataFrame) -> DataFrame:
    """One row for each named check of a document.

    ``blocks``: document_id, ord, version, status, xml. ``exported``: document_id, xml, sha256.
    """
    made = B.documents(blocks)
    both = made.join(exported.select("document_id", F.col("xml").alias("exported"), "sha256"), "document_id", "left")
    w = W.partitionBy("document_id")
    numbered = blocks.withColumn("want", F.row_number().over(w.orderBy("ord")) - 1)
    per = numbered.groupBy("document_id").agg(F.bool_and(F.col("want") == F.col("ord")).alias("numbering"), F.bool_and(F.col("status").isin("ok", "fallback", "unresolved")).alias("terminal"), F.bool_and(F.col("version") >= 0).alias("versions"))
    valid = B.validated(both.select("document_id", "xml"), kind="document").select("document_id", F.col("check.valid").alias("grammar"))
    same = both.select("document_id", F.coalesce(F.col("xml") == F.col("exported"), F.lit(False)).alias("export"), F.coalesce(T.sha256(F.col("exported")) == F.col("sha256"), F.lit(False)).alias("digest"))
    wide = per.join(valid, "document_id").join(same, "document_id")
    names = ["numbering", "terminal", "versions", "grammar", "export", "digest"]
    return wide.select("document_id", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in names))))


def run_evidence(documents: DataFrame, calls: DataFrame, phases: DataFrame) -> DataFrame:
    """``document_id, name, passed``: what the runs of ``documents`` (``document_id``) left behind.

    ``calls``: document_id, call_id, inspected_tokens, prompt_tokens (null without a reply): a check for each call with a reply, whose prompt must have had as
    many tokens as were counted before. ``phases``: document_id, phase, cleanup_verified, recovery_verified_at: whether there are any figures, and
    for each phase whether its memory was found free, after it or when a later run recovered.
    """
    counted = calls.filter("prompt_tokens IS NOT NULL").select("document_id", F.concat(F.lit("actual_prompt_tokens:"), "call_id").alias("name"), F.col("prompt_tokens").eqNullSafe(F.col("inspected_tokens")).alias("passed"))
    freed = F.coalesce("cleanup_verified", F.lit(False)) | F.col("recovery_verified_at").isNotNull()
    cleaned = phases.select("document_id", F.concat(F.lit("phase_cleanup:"), F.col("phase").cast("string")).alias("name"), freed.alias("passed"))
    known = phases.select("document_id").distinct().withColumn("there", F.lit(True))
    available = documents.select("document_id").join(known, "document_id", "left").select("document_id", F.lit("phase_metrics_available").alias("name"), F.col("there").isNotNull().alias("passed"))
    return counted.union(cleaned).union(available)


def image_report(blocks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per image: blocks by status, repairs and error codes.

    ``attempts``: document_id, image_id, kind, status, error_code.
    """
    by = ["document_id", "image_id"]
    counts = blocks.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "fallback", "unresolved")))
    repairs = attempts.groupBy(*by).agg(F.count_if(F.col("kind") == "repair").alias("repairs"), F.count("*").alias("requests"), F.array_sort(F.collect_set("error_code")).alias("codes"))
    return counts.join(repairs, by, "left").select(*by, "ok", "fallback", "unresolved", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("repairs", "requests")), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def needs_review(blocks: DataFrame, ocr: DataFrame, ratios: DataFrame, warnings: DataFrame) -> DataFrame:
    """Whether a document needs a review: a block that isn't ok, incomplete recognition, a known
    ratio below 0.8, or a warning. Unknown ratios don't count."""
    sides = [
        blocks.select("document_id", (F.col("status") != "ok").alias("bad")),
        ocr.select("document_id", (~F.coalesce("complete", F.lit(False))).alias("bad")),
        ratios.select("document_id", (F.coalesce(F.col("coverage") < 0.8, F.lit(False)) | F.coalesce(F.col("support") < 0.8, F.lit(False))).alias("bad")),
        warnings.select("document_id", F.lit(True).alias("bad")),
    ]
    return reduce(DataFrame.unionByName, sides).groupBy("document_id").agg(F.bool_or("bad").alias("needs_review"))


def passed(checks: DataFrame) -> DataFrame:
    """Passed and total of visual checks, and whether all passed (null without any)."""
    return checks.groupBy("document_id").agg(F.count_if("passed").alias("n_passed"), F.count("*").alias("n"), F.bool_and("passed").alias("all_passed"))
