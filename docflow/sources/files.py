"""Sources: manifests, images, checkpoints, logs and event streams as DataFrames."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import png
from ..functions import text as X

IMAGE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("path", T.StringType())])
MANIFEST = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("ordered_image_ids", T.ArrayType(T.StringType())),
    ]
)


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files of one object each; keys that the schema doesn't have are an error, as are bad files."""
    raw = spark.read.text(path, wholetext=True)
    known = F.array(*(F.lit(n) for n in schema.fieldNames()))
    extra = F.array_except(F.json_object_keys("value"), known)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(extra, ", "))).cast(schema)).otherwise(parsed)
    return raw.select(checked.alias("r")).select("r.*")


def manifest_fault() -> F.Column:
    """The first rule that a manifest breaks, null if none."""
    ids = F.transform("images", lambda i: i["image_id"])
    order = F.col("ordered_image_ids")
    return F.coalesce(
        F.when(~X.valid_id(F.col("document_id")), "DOCUMENT_ID"),
        F.when(F.exists(ids, lambda i: ~X.valid_id(i)), "IMAGE_ID"),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), "DUPLICATE_IMAGE"),
        F.when(F.coalesce(F.size(order), F.lit(0)) < 1, "EMPTY_ORDER"),
        F.when(F.size(F.array_distinct(order)) != F.size(order), "DUPLICATE_ORDER"),
        F.when(F.size(F.array_except(order, ids)) > 0, "UNKNOWN_IMAGE"),
    )


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the language's default and ``fault``, null for good ones."""
    rows = strict_json(spark, path, MANIFEST).withColumn("lang", F.coalesce("lang", F.lit("zh-CN")))
    return rows.withColumn("fault", manifest_fault())


def ordered_images(manifest: DataFrame) -> DataFrame:
    """``document_id, image_ord, image_id, path`` in final order."""
    paths = F.map_from_entries("images")
    order = manifest.filter("fault IS NULL").select("document_id", paths.alias("paths"), F.posexplode("ordered_image_ids").alias("image_ord", "image_id"))
    return order.select("document_id", "image_ord", "image_id", F.element_at("paths", F.col("image_id")).alias("path"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content's digest and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def verified(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files whose digest is as wanted (``path, wanted_sha256``); another one is an error, as is a path
    that leaves its folder."""
    joined = wanted.join(files, "path", "left")
    safe = ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    good = safe & F.coalesce(F.col("sha256") == F.col("wanted_sha256"), F.lit(False))
    return joined.withColumn("content", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed or missing: "), F.col("path"))).cast("binary")))


def reference_state(path: F.Column, sha256: F.Column, wanted: F.Column) -> F.Column:
    """What is wrong with a reference: its path leaves the folder, or the content has another digest (or is missing)."""
    escapes = path.rlike(r"(^|/)\.\.(/|$)") | path.startswith("/")
    return F.when(escapes, "escapes").when(~F.coalesce(sha256 == wanted, F.lit(False)), "changed").otherwise("good")


def fingerprints(files: DataFrame, small: int = 1 << 20) -> DataFrame:
    """A snapshot's parts, from ``path, bytes, content``: the digest only of files of at most ``small`` bytes."""
    return files.withColumn("sha256", F.when(F.col("bytes") <= small, F.sha2("content", 256))).drop("content")


def data_urls(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return files.select(*(keep or ["path"]), X.data_url(F.col("content"), F.col("path")).alias("url")).filter("url IS NOT NULL")


def used_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """XML fragments in the order of the list, whatever their names are."""
    order = spark.createDataFrame(list(enumerate(paths)), "ord int, wanted string")
    bare = lambda p: F.regexp_replace(p, r"^\w+:/*", "/")  # noqa: E731  # however the scheme is written
    own = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    files = spark.read.text(paths, wholetext=True).select(bare(own).alias("file"), F.col("value").alias("xml"))
    return order.join(files, F.col("file") == bare(F.col("wanted"))).select("ord", "xml").orderBy("ord")


def metrics(spark: SparkSession, glob: str) -> DataFrame:
    """Figures of all runs with the file that they come from."""
    return spark.read.json(glob, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def cache_capacity(spark: SparkSession, path: str) -> DataFrame:
    """The last capacity that each log reports."""
    logs = spark.read.text(path, wholetext=True)
    return logs.select(F.input_file_name().alias("file"), X.last_capacity(F.col("value")).alias("tokens"))


def tail_lines(lines: DataFrame, n: int = 80) -> DataFrame:
    """The last lines of each file of ``file, line_no, line``."""
    r = F.row_number().over(W.partitionBy("file").orderBy(F.desc("line_no")))
    return lines.withColumn("r", r).filter(F.col("r") <= n).drop("r")


def event_frames(text: DataFrame) -> DataFrame:
    """``stream, frame, id, event, data`` of server-sent events in ``stream, body``: frames end with a
    blank line, data lines are joined, comments are left out."""
    frames = text.select("stream", F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n\n+")).alias("frame", "raw"))
    lines = F.filter(F.split("raw", "\n"), lambda x: ~x.startswith(":"))

    def values(name: str):
        own = F.filter(lines, lambda x: x.startswith(name + ":") | (x == name))
        return F.transform(own, lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))

    made = frames.select("stream", "frame", F.try_element_at(values("id"), F.lit(-1)).alias("id"), F.try_element_at(values("event"), F.lit(-1)).alias("event"), F.array_join(values("data"), "\n").alias("data"), F.size(values("data")).alias("n"))
    return made.filter("n > 0").drop("n")


def imported_ocr(images: DataFrame, earlier: DataFrame, failed_attempts: int | None = None) -> DataFrame:
    """Recognised text of an earlier run for the same images; a different image is an error.

    With ``failed_attempts``, failed ones are taken as well if they have exactly so many attempts.
    """
    mine = images.select("document_id", "image_id", F.col("sha256").alias("own"))
    joined = mine.join(earlier, ["document_id", "image_id"])
    same = F.coalesce(F.col("own") == F.col("sha256"), F.lit(False))
    content = F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("another image: "), F.col("image_id"))))
    ended = F.col("complete") if failed_attempts is None else F.col("complete") | (F.col("attempts") == failed_attempts)
    return joined.withColumn("content", content).filter(ended).drop("own")


def tasks(raw: DataFrame, schema: str) -> DataFrame:
    """Client tasks from JSON arrays in ``value``; repeated or unsafe ids are an error."""
    lists = raw.select(F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"}).alias("t"))
    ids = F.transform("t", lambda t: t["taskId"])
    bad = (F.size(F.array_distinct(ids)) != F.size(ids)) | F.exists(ids, lambda i: ~X.valid_id(i))
    checked = F.when(bad, F.raise_error(F.lit("repeated or unsafe task id")).cast(f"array<struct<{schema}>>")).otherwise(F.col("t"))
    return lists.select(F.inline(checked))


def recovered_pages(pages: DataFrame) -> DataFrame:
    """Pages after a cold start: what was under way is taken again where a file is left, else anew."""
    state = F.when(F.col("state").isin("READY", "RETAKE_REQUIRED"), F.col("state")).when(F.col("has_ready_file"), "READY").when(F.col("has_raw_file"), "NORMALIZING").otherwise("RETAKE_REQUIRED")
    return pages.withColumn("state", state)


def memory_samples(lines: DataFrame) -> DataFrame:
    """Readings of ``sample, line`` (used and total, parted by a comma, units left out): ``sample, used, total``; a line that isn't one is an error."""
    found = F.regexp_extract_all("line", F.lit(r"([0-9]+)(?: MiB)?"), F.lit(1))
    good = F.col("line").rlike(r"^\s*[0-9]+(?: MiB)?\s*,\s*[0-9]+(?: MiB)?\s*$")
    value = lambda k: F.when(good, F.element_at(found, k).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no reading: "), F.col("line"))).cast("long"))
    return lines.select("sample", value(1).alias("used"), value(2).alias("total"))


def normalized_images(images: DataFrame) -> DataFrame:
    """``images`` (``image_id, content``: PNG files) as ``image_id, width, height, png, sha256, problem``: decoded, turned, as RGB and written anew, with
    the digest of the new file; a file that can't be read has a code in ``problem`` instead."""

    @F.pandas_udf("width int, height int, png binary, sha256 string, problem string")
    def made(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                pixels = png.decode(bytes(data or b""))
                new = png.encode(pixels)
                rows.append((pixels.shape[1], pixels.shape[0], new, hashlib.sha256(new).hexdigest(), None))
            except png.Unreadable as e:
                rows.append((None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "png", "sha256", "problem"]).astype({"width": "Int32", "height": "Int32"})

    return images.select("image_id", made("content").alias("m")).select("image_id", "m.*")
