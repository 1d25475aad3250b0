"""Assembly as a stream: images and replies come one at a time, each document keeps where it is.

Events (``EVENT_DDL``) are ``image`` (recognised text, whether it is all), ``reply`` (to the call of that number; the first call makes the draft) and
``close`` (an image will get no more replies). Answers (``ANSWER_DDL``) are ``ask`` (a call that has to be made, and for which rows), ``received`` (a
reply, once: the log of replies) and ``block`` (a committed block; a tail that is continued comes again with its next version).

The state of a document is what it has committed, by place, and of its open images the replies received, by call, and which call has been asked
for. It is in the checkpoint as soon as a batch is, so a stream that stops goes on with the replies that it has, and asks for
none of them again. An image is folded by the functions of the batch fold, once its first reply is there, from its own replies alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from ..functions import align
from ..operators import drafts

EVENT_DDL = "document_id string, image_ord int, kind string, call int, image_id string, content string, finish_reason string, complete boolean"
ANSWER_DDL = f"document_id string, kind string, image_ord int, call int, targets array<string>, content string, finish_reason string, {drafts.BLOCK_DDL.partition(', ')[2]}"
EVENT, NAMES = ([c.split()[0] for c in ddl.split(", ")] for ddl in (EVENT_DDL, ANSWER_DDL))
ANSWER = Row(*NAMES)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TEXT = T.StructType([T.StructField("text", T.StringType())])
NUMBERS = T.StructType([T.StructField("image", T.IntegerType()), T.StructField("blocks", T.IntegerType()), T.StructField("asked", T.IntegerType())])
CALL = T.StructType([T.StructField("image", T.IntegerType()), T.StructField("call", T.IntegerType())])
PLACE = T.StructType([T.StructField("place", T.IntegerType())])

#: Stands for the call of an image's own row and of its closing in the log of calls.
IMAGE, CLOSE = -1, -2


class Assembly(StatefulProcessor):
    """One document: ``at`` (the image under way, how many blocks there are, the last call asked for), ``calls`` (what came for open images), ``blocks``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", NUMBERS)
        self.calls = handle.getMapState("calls", CALL, TEXT)
        self.blocks = handle.getMapState("blocks", PLACE, TEXT)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        at = self.at.get()
        document = Open(self, *(at or (0, 0, -1)), {tuple(k): v[0] for k, v in self.calls.iterator()} if at else {})
        for r in rows:
            document.receive(*(r[c] for c in EVENT[1:]))
        document.advance()
        document.keep()
        for made in document.out:
            yield ANSWER(key[0], *(made.get(c) for c in NAMES[1:]))


class Open:
    """A document while it gets events: its state is read once and written once, since each access to the store is a message to another process."""

    def __init__(self, store: Assembly, image: int, n: int, asked: int, calls: dict[tuple[int, int], str]) -> None:
        self.store, self.image, self.n, self.asked, self.calls = store, image, n, asked, calls
        self.before, self.changed, self.out = dict(calls), {}, []

    @cached_property
    def committed(self) -> list[dict]:
        return [json.loads(v[0]) for _, v in sorted(((tuple(k), v) for k, v in self.store.blocks.iterator()), key=lambda b: b[0])] if self.n else []

    def receive(self, image_ord: int, kind: str, call: int | None, image_id: str | None, content: str | None, finish_reason: str | None, complete: bool | None) -> None:
        """An event of an image that isn't done, the first time that it comes."""
        where = (image_ord, {"image": IMAGE, "close": CLOSE}.get(kind, call))
        if where[0] < self.image or where in self.calls:
            return
        self.calls[where] = json.dumps([image_id, content, finish_reason, bool(complete)])
        if kind == "reply":
            self.out.append({"kind": "received", "image_ord": where[0], "call": where[1], "content": content, "finish_reason": finish_reason})

    def came(self, call: int) -> list | None:
        found = self.calls.get((self.image, call))
        return None if found is None else json.loads(found)

    def advance(self) -> None:
        """As many images as what has come is enough for; then the call that is missing, if it hasn't been asked for."""
        while (given := self.came(IMAGE)) is not None:
            image_id, content, _, complete = given
            replies = []
            while (reply := self.came(len(replies))) is not None:
                replies.append((reply[1], reply[2]))
            closed, targets, draft = self.came(CLOSE) is not None, [], None
            if replies or closed:
                lines = align.source_lines(content or "", image_id)
                draft = drafts.drafted(image_id, replies, lines, self.committed, complete)
                targets = drafts.next_attempt(draft)
            if not closed and (draft is None or targets is not None):
                if self.asked < len(replies):
                    self.asked = len(replies)
                    self.out.append({"kind": "ask", "image_ord": self.image, "call": self.asked, "targets": targets})
                break
            now = drafts.concluded(draft, lines, self.committed)
            for k, b in enumerate(now):
                if k >= self.n or b is not self.committed[k]:
                    self.changed[k] = b
                    self.out.append({"kind": "block", "image_ord": self.image, "ord": k} | dict(zip(NAMES[8:], drafts.block_row(b), strict=True)))
            for call in (IMAGE, CLOSE, *range(len(replies))):
                self.calls.pop((self.image, call), None)
            self.committed, self.image, self.n, self.asked = now, self.image + 1, len(now), -1

    def keep(self) -> None:
        """What has changed, written to the store."""
        for k, b in self.changed.items():
            self.store.blocks.updateValue((k,), (json.dumps(b),))
        for where in self.before.keys() - self.calls.keys():
            self.store.calls.removeKey(where)
        for where in self.calls.keys() - self.before.keys():
            self.store.calls.updateValue(where, (self.calls[where],))
        self.store.at.update((self.image, self.n, self.asked))


def assembling(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of answers from one of events. Its query has to start within :func:`with_state`, or in a session whose state store
    is RocksDB."""
    return events.groupBy("document_id").transformWithState(Assembly(), ANSWER_DDL, "Update", "None")


def answering(spark: SparkSession, events: str, target: str) -> StreamingQuery:
    """A running query that answers all events in the folder ``events`` into ``target`` and ends: answers by batch, so that one which is written again takes its own place,
    and the checkpoint beside them, from which the next query goes on."""

    def write(answers: DataFrame, batch: int) -> None:
        answers.write.mode("overwrite").parquet(f"{target}/answers/batch={batch}")

    with with_state(spark):
        stream = assembling(spark.readStream.schema(EVENT_DDL).parquet(events)).writeStream.foreachBatch(write).outputMode("update")
        return stream.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()


def answers(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{ANSWER_DDL}, batch long").parquet(f"{target}/answers")


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """The state store that such a stream needs, for queries that start here; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def committed(given: DataFrame) -> DataFrame:
    """The committed blocks in a table of answers: of each place the last version."""
    last = F.row_number().over(W.partitionBy("document_id", "ord").orderBy(F.desc("version"), F.desc("image_ord")))
    columns = [c.split()[0] for c in drafts.BLOCK_DDL.split(", ")]
    return given.filter("kind = 'block'").withColumn("last of its place", last).filter("`last of its place` = 1").select(columns)


def as_events(images: DataFrame) -> DataFrame:
    """Recorded images (``document_id, image_ord, image_id, content, calls`` and perhaps ``complete``) as events, with ``step`` 0 for what comes first, then by
    call, and the closing of the image last."""
    complete = F.col("complete") if "complete" in images.columns else F.lit(True)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    key = ("document_id", F.col("image_ord").cast("int").alias("image_ord"))
    image = images.select(*key, F.lit("image").alias("kind"), none("int", "call"), "image_id", "content", none("string", "finish_reason"), complete.alias("complete"), F.lit(0).alias("step"))
    call = images.select(*key, F.posexplode("calls").alias("call", "c")).select("document_id", "image_ord", F.lit("reply").alias("kind"), "call", none("string", "image_id"), "c.content", "c.finish_reason", none("boolean", "complete"), F.col("call").alias("step"))
    close = images.select(*key, F.lit("close").alias("kind"), none("int", "call"), none("string", "image_id"), none("string", "content"), none("string", "finish_reason"), none("boolean", "complete"), F.greatest(F.size("calls"), F.lit(0)).alias("step"))
    return image.union(call).union(close)
