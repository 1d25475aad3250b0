"""Helpers shared by the operators: words, the shared folder, tables written and read again."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import scratch, shared_dir

#: What separates words: the space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
#: The same characters, for ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Folders of the tables stored on the way to a computed one, in this thread; None outside of that.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The array of words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES + "+")
    return F.filter(parts, lambda w: w != "")


def stored(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage, survives the
    loss of executors, and is computed once however often it is used. With ``parts``, in at most so
    many files: for tables whose rows have been counted and are few."""
    spark = df.sparkSession
    if parts:
        df = df.coalesce(parts)
    path = scratch(spark, name)
    df.write.parquet(path)
    if (written := WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if urlsplit(folder).path.startswith(urlsplit(shared_dir(spark)).path):
            delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def computed(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; the tables that were stored on the way are deleted."""
    outer = WRITTEN.set([])
    try:
        made = stored(make(), name)
        *on_the_way, last = WRITTEN.get()
    finally:
        WRITTEN.reset(outer)
    for path in on_the_way:
        delete(spark, path)
    if (written := WRITTEN.get()) is not None:
        written.append(last)
    return made


def has_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` cut down to ``names``, so that further columns can't clash with made ones."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def perhaps_in(column: Column, ids: DataFrame, bits: int = 23) -> Column:
    """Whether ``column`` may be among ``ids`` (one column of numbers): surely not where it is false.

    A Bloom filter of fixed size (2**bits bits, 1 MiB), whatever the number of ids; the more of them, the more
    others pass. It only saves shuffles: an exact join has to follow.
    """
    name = ids.columns[0]
    places = F.array(*(hashed_place(F.col(f"`{name}`"), k, bits) for k in range(2)))
    marks = ids.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 5).cast("int").alias("w"))
    words = np.zeros(1 << (bits - 5), np.uint32)
    made = marks.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(31)).cast("int"))).alias("b")).toArrow()
    words[made.column("w").to_numpy()] = made.column("b").to_numpy().astype(np.uint32)
    table = ids.sparkSession.createDataFrame(pa.table({"b": pa.array([words.tobytes()], pa.binary())})).scalar()

    def marked(k: int) -> Column:
        place = hashed_place(column, k, bits)
        byte = F.conv(F.hex(F.substring(table, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.coalesce(marked(0) & marked(1), F.lit(False))


def hashed_place(column: Column, k: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column.cast("long"), F.lit(k)), 64 - bits)


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (one column of ids); those without an id stay.

    Rows that a filter of fixed size clears go straight on, so that only the others are shuffled.
    """
    name = "gone " + uuid.uuid4().hex
    suspect = perhaps_in(F.col(f"`{id_col}`"), gone)
    rest = docs.filter(suspect).join(gone.select(F.col(f"`{gone.columns[0]}`").alias(name)), F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
    return docs.filter(~suspect).union(rest)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, which long texts make large for a worker; a session's own
    setting stays."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def release() -> None:
    """Freed memory given back to the system, at the end of a task: a worker waits for its next one with what it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str) -> DataFrame:
    """Each Arrow batch turned into another one. ``make()`` is called once a task and gives the
    function from a batch to the columns (Arrow arrays, or values for them) in the order of ``ddl``."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns(batch), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)
            del batch, made
        release()

    return df.mapInArrow(run, ddl)


def sampled(rows: DataFrame, by: list[str], id_col: str, most: int | dict[tuple, int], salt: str) -> DataFrame:
    """For each group ``by`` those of ``rows`` whose ids have the smallest hashes, at most ``most`` (for all groups, or for
    each): all of a group that has no more, and else as many as whole eighths of a doubling of the hash allow.

    Counts by group and size of the hash tell where to cut, so that no group has to be sorted.
    """
    u = F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit(salt)), 1) / F.lit(float(1 << 63))
    leveled = rows.withColumn("level", F.floor(-8 * F.log2(F.greatest(u, F.lit(2.0**-62)))).cast("int"))
    counts = leveled.groupBy(*by, "level").agg(F.count("*").alias("k"))  # some hundreds of levels a group
    cuts: dict[tuple, tuple[int, int]] = {}
    for r in sorted(counts.collect(), key=lambda r: -r["level"]):
        key = tuple(r[c] for c in by)
        total, cut = cuts.get(key, (0, 1 << 20))
        limit = most if isinstance(most, int) else most[key]
        cuts[key] = (total + r["k"], r["level"] if total + r["k"] <= limit else cut)
    chosen = F.lit(False)
    for key, (_, cut) in cuts.items():
        same = F.col("level") >= cut
        for c, v in zip(by, key, strict=True):
            same &= F.col(c).eqNullSafe(F.lit(v))
        chosen |= same
    return leveled.filter(chosen).drop("level")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, typed."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
