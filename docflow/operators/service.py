"""The service's tables: admission of uploads, capacity, progress, queue, tokens and connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ENDED = ("COMPLETED", "FAILED")


def upload_admission(uploads: DataFrame, documents: DataFrame, images: DataFrame, running: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``upload_id, code``: the first rule that an upload breaks, ``KNOWN`` where the image is there already, null where it may begin.

    ``uploads``: upload_id, document_id, image_id, sha256, size. ``documents``: document_id, status, finalized. ``images``:
    document_id, image_id, sha256, size, and ``running`` (under way): document_id, image_id, reserved. ``limits``: upload, images,
    data, free and the ``disk`` that is free. Uploads are judged one by one, each as if it were the next.
    """
    per = [images.groupBy("document_id").agg(F.count("*").alias("there")), running.groupBy("document_id").agg(F.count("*").alias("coming"))]
    rows = reduce(lambda a, b: a.join(b, "document_id", "left"), [documents.select("document_id", "status", "finalized"), *per], uploads)
    rows = rows.join(images.select("document_id", "image_id", F.col("sha256").alias("same image")), ["document_id", "image_id"], "left")
    rows = rows.join(running.select("document_id", "image_id", F.lit(True).alias("in flight")), ["document_id", "image_id"], "left")
    held = images.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("used")).first()["used"]
    reserved = running.agg(F.coalesce(F.sum("reserved"), F.lit(0)).alias("r")).first()["r"]
    code = F.coalesce(
        F.when((F.col("size") <= 0) | (F.col("size") > limits["upload"]), "SIZE"), F.when(F.col("status").isNull(), "DOCUMENT"),
        F.when(F.col("same image").isNotNull(), F.when(F.col("same image") == F.col("sha256"), "KNOWN").otherwise("CONFLICT")),
        F.when(F.col("finalized").isNotNull() | F.col("status").isin(*ENDED), "FROZEN"), F.when(F.col("in flight"), "IN_FLIGHT"),
        F.when(F.coalesce("there", F.lit(0)) + F.coalesce("coming", F.lit(0)) >= limits["images"], "COUNT"),
        F.when(held + reserved + F.col("size") > limits["data"], "CAPACITY"), F.when(limits["disk"] - reserved - F.col("size") < limits["free"], "DISK"),
    )
    return rows.select("upload_id", code.alias("code"))


def capacity(documents: DataFrame, images: DataFrame, running: DataFrame) -> DataFrame:
    """One row: documents that haven't ended, images with uploads under way, and reserved bytes."""
    sides = [
        documents.filter(~F.col("status").isin(*ENDED)).select(F.lit(1).alias("active"), F.lit(0).alias("images"), F.lit(0).cast("long").alias("reserved")),
        images.select(F.lit(0).alias("active"), F.lit(1).alias("images"), F.lit(0).cast("long").alias("reserved")),
        running.select(F.lit(0).alias("active"), F.lit(1).alias("images"), F.col("reserved").cast("long").alias("reserved")),
    ]
    both = reduce(DataFrame.union, sides)
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in both.columns))


def progress(images: DataFrame, batches: DataFrame) -> DataFrame:
    """``document_id, ocr, assembled, total``: recognised images that count, batches, and images that count
    (``document_id, image_id, ordered, complete``)."""
    counted = images.filter("ordered").groupBy("document_id").agg(F.count_if("complete").alias("ocr"), F.count("*").alias("total"))
    made = batches.groupBy("document_id").agg(F.count("*").alias("assembled"))
    return counted.join(made, "document_id", "left").select("document_id", "ocr", F.coalesce("assembled", F.lit(0)).alias("assembled"), "total")


def work_queue(documents: DataFrame, most: int = 100) -> DataFrame:
    """The head of the queue, with places from 1: finalized documents first, by time and id; unfinished ones only after them."""
    order = [F.col("finalized").isNull(), F.col("finalized"), F.col("document_id")]
    head = documents.filter(~F.col("status").isin(*ENDED)).select("document_id", "finalized").orderBy(*order).limit(most)
    return head.select("document_id", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))  # at most ``most`` rows


def accepted(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """Presented tokens (``request_id, token``) with the device whose digest they have, if it isn't revoked."""
    good = tokens.filter("revoked IS NULL").select("device_id", "digest")
    return presented.select("request_id", F.sha2("token", 256).alias("digest")).join(good, "digest").select("request_id", "device_id")


#: Changes that are put together by one group.
SPAN = 4096


def connections(changes: DataFrame, cap: int = 2, span: int = SPAN) -> DataFrame:
    """``device_id, document_id, open, refused``: streams open at the end and openings refused, from openings and closings
    (``device_id, document_id, seq``, distinct and not negative, ``step`` 1 or -1). An opening is refused while ``cap`` are open.

    A change is a table of what it makes of 0 to ``cap`` open streams; tables compose, ``span`` of them at a time, so no group holds more than
    that however many changes a key has.
    """
    opening = F.array(*(F.struct(F.lit(min(k + 1, cap)).alias("open"), F.lit(int(k >= cap)).cast("long").alias("refused")) for k in range(cap + 1)))
    closing = F.array(*(F.struct(F.lit(max(k - 1, 0)).alias("open"), F.lit(0).cast("long").alias("refused")) for k in range(cap + 1)))
    as_it_is = F.array(*(F.struct(F.lit(k).alias("open"), F.lit(0).cast("long").alias("refused")) for k in range(cap + 1)))

    def then(now: Column, x: Column) -> Column:
        return F.transform(now, lambda a: F.struct(F.get(x["t"], a["open"])["open"].alias("open"), (a["refused"] + F.get(x["t"], a["open"])["refused"]).alias("refused")))

    rows = changes.select("device_id", "document_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("step") > 0, opening).otherwise(closing).alias("t"))
    last = changes.agg(F.max("seq")).first()[0] or 0
    while True:
        cut = rows.groupBy("device_id", "document_id", F.floor(F.col("seq") / span).alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("c"))
        rows = cut.select("device_id", "document_id", "seq", F.aggregate("c", as_it_is, then).alias("t"))
        last //= span
        if not last:
            return rows.select("device_id", "document_id", F.col("t")[0].alias("s")).select("device_id", "document_id", "s.open", "s.refused")


def read_blocks(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks by ordinal, in the order asked for (``request_id, document_id, ordinals``: one to three): ``request_id, place, ord, text``.
    A request beyond the document's blocks is an error."""
    wanted = asked.select("request_id", "document_id", F.posexplode("ordinals").alias("place", "ord"))
    found = wanted.join(blocks.select("document_id", "ord", "text"), ["document_id", "ord"], "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no block "), F.col("ord").cast("string")))).otherwise(F.col("text"))
    return found.select("request_id", "place", "ord", text.alias("text"))


def search_blocks(blocks: DataFrame, asked: DataFrame, most: int = 3) -> DataFrame:
    """The first blocks that hold a text to the letter (``request_id, document_id, search``; blank or long ones find nothing)."""
    sound = asked.filter((F.trim("search") != "") & (F.length("search") <= 200))
    hits = blocks.join(sound, "document_id").filter(F.contains("text", F.col("search")))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("ord"))
    return hits.select("request_id", "ord", place.alias("place")).filter(F.col("place") <= most)
