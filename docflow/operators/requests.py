"""What a request for a repair or the next image is made of, one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

VIEW = ("ord", "id", "version", "xml", "text", "status")


def listed(condition: Column) -> Column:
    """The blocks for which a condition holds, in order."""
    return F.array_sort(F.collect_list(F.when(condition, F.struct(*VIEW))))


def contexts(draft: DataFrame, history: DataFrame, retrieved: DataFrame | None = None, options: DataFrame | None = None, recent: int = 3) -> DataFrame:
    """Targets with their neighbours, the last history with its tail, and what else a request carries.

    ``draft``: document_id, ord, id, version, xml, text, status, target. ``history``: the same without target, the
    committed blocks. ``retrieved``: document_id, ord of earlier blocks that resemble the image; those that are
    shown anyway are left out. ``options``: document_id, option_id, xml of safe repairs; where there are some, a
    choice among them is all that is asked for.
    """
    row = W.partitionBy("document_id").orderBy("ord")
    near = F.coalesce(F.lag("target").over(row), F.lit(False)) | F.coalesce(F.lead("target").over(row), F.lit(False))
    own = draft.withColumn("near", near).groupBy("document_id").agg(listed(F.col("target")).alias("targets"), listed(F.col("near") & ~F.col("target")).alias("neighbours"))
    from_end = F.row_number().over(W.partitionBy("document_id").orderBy(F.desc("ord")))
    titled = F.bool_or(F.coalesce(F.col("xml").contains("<title"), F.lit(False))).over(W.partitionBy("document_id"))
    ended = history.withColumns({"from_end": from_end, "titled": titled, "blocks": F.count("*").over(W.partitionBy("document_id"))}).filter(F.col("from_end") <= recent)
    past = ended.groupBy("document_id").agg(
        listed(F.col("from_end") > 1).alias("recent"), F.max(F.when(F.col("from_end") == 1, F.struct(*VIEW))).alias("tail"), F.first("titled").alias("has_title"), F.first("blocks").alias("history_blocks")
    )
    made = own.join(past, "document_id", "left")
    if retrieved is not None:
        shown = ended.select("document_id", "ord")
        found = retrieved.join(shown, ["document_id", "ord"], "left_anti").join(history, ["document_id", "ord"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*VIEW))).alias("retrieved"))
        made = made.join(found, "document_id", "left")
    if options is not None:
        offered = options.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("option_id", "xml"))).alias("options"))
        made = made.join(offered, "document_id", "left")
    scope = F.when(F.size("targets") == 0, "generate").otherwise("repair")
    if options is not None:
        scope = F.when(F.size("options") > 0, "choose").otherwise(scope)
    return made.withColumn("mode", scope)
