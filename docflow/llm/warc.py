"""WARC archives: pages written as records, and records read back, segments reassembled.

Writing: each page is a ``response`` record whose HTTP body goes in chunks; a block longer than ``SEGMENT`` bytes is cut into a first record
and ``continuation`` records. Of pages with equal payloads the one with the smallest id is kept, the others are ``revisit``
records without a body. Only pages whose payload others share are shuffled for that. Spark's text writer puts the records into gzip files of any file
system that it knows, with the two line ends after each record as its separator.

Reading: the text reader gives a file's pieces between such separators in order, from which the records are cut by their
``Content-Length``; a task holds one record at a time. Segments are dealt by the record that they continue, sorted by
number, and joined once they are complete and as long as the last one says; then chunks are decoded and digests compared.

Edge cases: a null text is an empty payload; pages without an id are ``response`` unless a page with one has the same
payload; rows that share id and payload are of one type, each with its own record. Null addresses are left out. Further columns
are ignored, an empty table gives no records. A record that can't be read whole has its fault in ``problem`` and no payload:
``record`` (its head or length), ``http``, ``segments`` (missing, repeated or unlike its total), ``chunks``, ``digest``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import scratch
from .common import delete, perhaps_in, release, small_batches, stored

END = b"\r\n\r\n"
#: Bytes of a block from which it is cut, and of the chunks of an HTTP body.
SEGMENT, CHUNK = 1 << 14, 1 << 12
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked"
#: Header fields of this engine: the row's number of a page, and that of the page that it repeats.
PAGE, ORIGINAL = "X-Page-Id", "X-Refers-To-Page-Id"


def digest(payload: bytes) -> str:
    """The SHA-1 of a payload in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the line ends after it; fields without a value are left out."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + END + block


def in_chunks(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + END


def page_records(number: int, page_id: int | None, url: str | None, payload: bytes, original: int | None, original_url: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit if there is an original, else a response, cut into segments if it is long."""
    name = lambda k: f"<urn:page:{number}:{k}>"
    uri = lambda x: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x) if x else None
    fields = {"WARC-Type": "response", "WARC-Record-ID": name(1), "WARC-Date": DATE, "WARC-Target-URI": uri(url), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest(payload)}", PAGE: page_id}
    if original is not None:
        return [record(fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": uri(original_url), "WARC-Refers-To-Date": DATE, ORIGINAL: original}, HTTP + END)]
    block = HTTP + END + in_chunks(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    more = [{"WARC-Type": "continuation", "WARC-Record-ID": name(k), "WARC-Date": DATE, "WARC-Target-URI": uri(url), "WARC-Segment-Origin-ID": name(1), "WARC-Segment-Number": k} for k in range(2, len(parts) + 1)]
    more[-1]["WARC-Segment-Total-Length"] = len(block)
    return [record(f, p) for f, p in zip([fields | {"WARC-Segment-Number": 1}, *more], parts, strict=True)]


def originals(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``key, first`` (id and address of the smallest id) of the payloads that several of ``pages`` have."""
    kept = pages.filter(F.octet_length("payload") >= least_bytes)
    shared = kept.groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
    return stored(shared.filter("n > 1 AND first IS NOT NULL").select("key", "first"), "shared-payloads")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Records of all ``pages`` as gzip archives in the folder ``path``; equal payloads of ``least_bytes`` or more are written once."""
    column = lambda c, kind, name: F.col(f"`{c}`").cast(kind).alias(name)
    rows = pages.select(column(id_col, "long", "page_id"), column(url_col, "string", "url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("number", F.monotonically_increasing_id()).withColumn("key", F.sha2("payload", 256))
    first = originals(rows, least_bytes)
    suspect = perhaps_in(F.xxhash64("key"), first.select(F.xxhash64("key").alias("h"))) & (F.octet_length("payload") >= least_bytes)
    alone = rows.filter(~suspect).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    joined = rows.filter(suspect).join(first, "key", "left").select(alone.columns)
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first.page_id"))
    given = alone.union(joined).select(
        "number", "page_id", "url", F.col("payload").cast("binary").alias("payload"), F.when(later, F.col("first.page_id")).alias("original"), F.when(later, F.col("first.url")).alias("original_url")
    )
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in page_records(*row, segment=segment)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
        release()

    records = given.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


# Reading


class Record(NamedTuple):
    """A record as it is in an archive: its fields, named in lower case, and its block."""

    fields: dict[str, str]
    block: bytes
    problem: str | None = None


class Cutter:
    """Records cut from the pieces of one file, each piece fed with the separator after it."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.least = 0  # bytes that the record under way needs

    def feed(self, piece: bytes) -> Iterator[Record]:
        self.held += piece
        self.held += END
        while len(self.held) >= self.least and (made := self.next()) is not None:
            yield made

    def next(self) -> Record | None:
        at = 0
        while self.held.startswith(b"\r\n", at):  # line ends after the last record
            at += 2
        del self.held[:at]
        head = self.held.find(END)
        if head < 0:
            return None
        fields = heading(bytes(self.held[:head]))
        size = fields.get("content-length", "") if fields is not None else ""
        if not size.isdecimal():  # what comes up to the next record's head is lost
            lost = bytes(self.held[:head])
            del self.held[: head + len(END)]
            return Record(fields or {}, lost, "record") if lost.startswith(b"WARC/") else self.next()
        end = head + len(END) + int(size)
        self.least = end
        if len(self.held) < end:
            return None
        self.least = 0
        block = bytes(self.held[head + len(END) : end])
        del self.held[:end]
        return Record(fields, block)

    def rest(self) -> Iterator[Record]:
        """A record that the file breaks off."""
        if self.held.strip(b"\r\n").startswith(b"WARC/"):
            head = self.held.find(END)
            yield Record(heading(bytes(self.held[:head])) or {}, bytes(self.held), "record")


def heading(text: bytes) -> dict[str, str] | None:
    """The fields of a record's head, lines that go on put together; None for another text."""
    version, _, lines = text.partition(b"\r\n")
    if not version.startswith(b"WARC/"):
        return None
    lines = re.sub(rb"\r\n[ \t]+", b" ", lines).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def out_of_chunks(body: bytes) -> bytes | None:
    """A body without its chunked framing; None where the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+(?=[ \t]*(?:;|$))", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n = int(size[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(parts) if body.endswith(END, end) or body[at:].endswith(END) else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> tuple[bytes | None, str | None]:
    """The body of an HTTP response without framing, or what is wrong with it."""
    head, found, body = block.partition(END)
    if not found or not head.startswith(b"HTTP/"):
        return None, "http"
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked[ \t]*\r?$", head):
        body = out_of_chunks(body)
        return body, None if body is not None else "chunks"
    return body, None


PAGES = "record_id string, page_id long, target_uri string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string"
SEGMENTS = "origin string, number int, total long, page_id long, target_uri string, digest string, block binary, problem string"


def whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def page_row(record_id: str | None, page_id: int | None, uri: str | None, kind: str, original: int | None, claimed: str | None, block: bytes | None, problem: str | None) -> tuple:
    """A row of ``PAGES``. A revisit has no payload of its own, only the digest of the one it repeats."""
    payload, said = None, (claimed or "").removeprefix("sha1:") or None
    if problem is None and kind == "response":
        payload, problem = http_payload(block)
        if payload is not None and said not in (None, digest(payload)):
            payload, problem = None, "digest"
    made = digest(payload) if payload is not None else said
    return record_id, page_id, uri, kind, original, payload, None if payload is None else len(payload), made, problem


def from_records(r: Record, segments: bool) -> tuple | None:
    """The row of a record: of ``SEGMENTS`` for one of several, else of ``PAGES``. None for a record of the other sort, or of a type that holds no page."""
    f = r.fields
    kind = f.get("warc-type", "")
    if segments != ("warc-segment-number" in f) or kind not in ("response", "revisit", "continuation") and r.problem is None:
        return None
    page, uri, said = whole_number(f.get(PAGE.lower())), f.get("warc-target-uri"), f.get("warc-payload-digest")
    if segments:
        origin = f.get("warc-segment-origin-id") or f.get("warc-record-id")
        return origin, whole_number(f["warc-segment-number"]), whole_number(f.get("warc-segment-total-length")), page, uri, said, r.block, r.problem
    return page_row(f.get("warc-record-id"), page, uri, kind or "unknown", whole_number(f.get(ORIGINAL.lower())), said, r.block, r.problem or ("record" if kind == "continuation" else None))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, payload: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some MiB, counted by the bytes of the column ``payload``."""
    at = schema.get_field_index(payload)
    make = lambda now: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*now, strict=True), schema, strict=True)], schema=schema)
    now, size = [], 0
    for row in rows:
        now.append(row)
        size += 200 + len(row[at] or b"")
        if size >= most:
            yield make(now)
            now, size = [], 0
    if now:
        yield make(now)


def archived(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """The rows of all records of the archives in ``path``, either those of several segments or the others."""
    pieces = spark.read.option("lineSep", END.decode()).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("from"), F.col("value").cast("binary").alias("piece")
    )
    small_batches(spark)
    ddl = SEGMENTS if segments else PAGES
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        file, cutter = None, Cutter()
        for batch in batches:
            for name, begin, piece in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if begin:
                    raise ValueError("archives must be compressed, or shorter than spark.sql.files.maxPartitionBytes")
                if name != file:
                    yield from filter(None, (from_records(r, segments) for r in cutter.rest()))
                    file, cutter = name, Cutter()
                yield from filter(None, (from_records(r, segments) for r in cutter.feed(piece)))
        yield from filter(None, (from_records(r, segments) for r in cutter.rest()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), schema, "block" if segments else "payload")
        release()

    return pieces.mapInArrow(run, ddl)


def joined(parts: list[tuple]) -> tuple:
    """The page of the segments of one record, in order of their numbers; a segment that comes twice alike counts once."""
    kept = [p for k, p in enumerate(parts) if not k or p[1:2] + p[6:7] != parts[k - 1][1:2] + parts[k - 1][6:7]]
    numbers, totals = [p[1] for p in kept], {p[2] for p in kept if p[2] is not None}
    block = b"".join(p[6] for p in kept)
    problem = next((p[7] for p in kept if p[7]), None)
    if numbers != list(range(1, len(kept) + 1)) or totals != {len(block)} or kept[-1][2] is None:
        problem = problem or "segments"
    origin, _, _, page, uri, said, _, _ = kept[0]
    return page_row(origin, page, uri, "response", None, said, block, problem)


def reassembled(segments: DataFrame) -> DataFrame:
    """The pages of records in several segments (``SEGMENTS``), wherever those stand."""
    dealt = segments.repartition("origin").sortWithinPartitions("origin", "number")
    schema = to_arrow_schema(T.StructType.fromDDL(PAGES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield joined(held)
                    held = []
                held.append(row)
        if held:
            yield joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(rows(batches), schema, "payload")
        release()

    return dealt.mapInArrow(run, PAGES)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The pages in the archives of the folder ``path`` (``PAGES``): responses with their payload, revisits with what they refer to.

    Compressed records of one segment never leave the task that reads them; only segments are shuffled.
    """
    return archived(spark, path, segments=False).union(reassembled(archived(spark, path, segments=True)))


def page_index(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, problem`` of read pages: revisits get the length of the payload that they
    refer to, or the problem ``revisit`` where no response has it."""
    index = stored(pages.drop("payload", "record_id", "target_uri"), "warc-index")
    revisits = index.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("original"), "payload_digest").distinct()
    have = index.filter("record_type = 'response' AND problem IS NULL").select(F.col("page_id").alias("original"), "payload_digest", F.col("payload_bytes").alias("bytes"))
    sizes = stored(wanted.join(have, ["original", "payload_digest"]).groupBy("original", "payload_digest").agg(F.max("bytes").alias("bytes")), "warc-originals")
    resolved = revisits.withColumnRenamed("refers_to", "original").join(sizes, ["original", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    problem = F.coalesce("problem", F.when(F.col("bytes").isNull(), "revisit"))
    return index.filter("record_type <> 'revisit'").select(columns).union(resolved.select("page_id", "bytes", "payload_digest", "record_type", "original", problem))


def round_trip(pages: DataFrame) -> DataFrame:
    """The index of ``pages`` written to archives in the shared folder and read again; the archives go once they are read."""
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path)
    index = page_index(read_archives(spark, path))
    delete(spark, path)
    return index
