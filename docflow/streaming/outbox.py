"""The outbox as a stream: what is new is sent, and what was last sent of each kind changes with it, in one version of a store.

A batch writes rows for the tables ``outbox`` and ``state`` and then one manifest that names both and the batch. If it fails before, neither
is there; if the stream fails after, the batch comes again and is left out, since its number is in the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import events
from ..sources import versions

STATE_DDL = "document_id string, kind string, signature string, seq long"
#: Versions after which the state is written anew, so that reading it doesn't grow with their number.
COMPACT = 64


def state(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """What was last sent of each document and kind."""
    return latest(versions.table(spark, path, "state", STATE_DDL, last))


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("document_id", "kind").agg(F.max_by("signature", "seq").alias("signature"), F.max("seq").alias("seq"))


def sender(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of batches of payloads (``document_id, kind, seq, payload`` and more columns) into the store ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = versions.versions(spark, path)
        if any(v.note["batch"] >= number for v in found):
            return
        change = versions.Change(spark, path, after=len(found))
        before = state(spark, path, len(found))
        sent = change.add("outbox", events.outbox(batch, before.drop("seq")))
        now = latest(sent.select("document_id", "kind", "signature", "seq"))
        if change.after % COMPACT == COMPACT - 1:
            change.replace("state", latest(before.unionByName(now)))
        else:
            change.add("state", now)
        change.commit(batch=number)

    return write


def sending(payloads: DataFrame, path: str) -> StreamingQuery:
    """A running query that sends what is in ``payloads`` (a streaming DataFrame) now, and ends; a later one goes on from its checkpoint."""
    stream = payloads.writeStream.foreachBatch(sender(path)).option("checkpointLocation", f"{path}/checkpoint")
    return stream.trigger(availableNow=True).start()
