"""A service's event streams as a source of Spark: ``spark.readStream.format("docflow_events")``.

Options: ``base`` (the service's address), ``documents`` (ids, parted by commas), ``token``, ``timeout`` in seconds. Rows are ``SCHEMA``, as the
replay of logs takes them. Offsets are the cursors of the documents: the driver asks each one's head, and executors
read from the cursor before to that one, a document a partition, and take up a broken connection where it broke. A document that
is new begins with its snapshot, and so does one whose cursor the service doesn't know any more: its readers start afresh.

One stream follows as many documents as a driver can ask within a batch, some thousands; others are for other streams.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "document_id string, seq long, kind string, data string"
FIRST_WAIT, LONGEST_WAIT, TRIES = 1.0, 30.0, 6


class Frame(NamedTuple):
    seq: int
    kind: str
    data: str


def frames(lines: Iterable[bytes]) -> Iterator[Frame]:
    """The events in the lines of a stream. What isn't ended by an empty line isn't one."""
    now: dict[str, str] = {}
    for raw in lines:
        line = raw.decode("utf-8").rstrip("\r\n")
        if not line:
            if "data" in now:
                yield Frame(int(now["id"]), now.get("event", "message"), now["data"])
            now = {}
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            now[name] = f"{now[name]}\n{value}" if name == "data" and name in now else value


class Service:
    """What a stream asks of a service."""

    def __init__(self, options: dict) -> None:
        self.base, self.token = options["base"].rstrip("/"), options.get("token")
        self.timeout = float(options.get("timeout", 30))
        self.documents = [d for d in options["documents"].split(",") if d]

    def events(self, document: str, cursor: int | None) -> Iterator[Frame]:
        """Events after a cursor, or (None) a snapshot and those after it, until the service or the connection ends. A cursor that the service
        refuses counts as none."""
        request = urllib.request.Request(f"{self.base}/v1/documents/{quote(document, safe='')}/events", headers={"Accept": "text/event-stream"})
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token}")
        if cursor is not None:
            request.add_header("Last-Event-ID", str(cursor))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                yield from frames(answer)
        except urllib.error.HTTPError as e:
            if e.code != 409 or cursor is None:
                raise
            yield from self.events(document, None)

    def head(self, document: str) -> int:
        """The cursor of a document's snapshot."""
        first = next(self.events(document, None), None)
        if first is None:
            raise ValueError(f"no snapshot of {document}")
        return first.seq

    def heads(self) -> dict[str, int]:
        with ThreadPoolExecutor(min(32, max(1, len(self.documents)))) as pool:
            return dict(zip(self.documents, pool.map(self.head, self.documents), strict=True))

    def between(self, document: str, after: int | None, end: int) -> Iterator[Frame]:
        """Events after a cursor up to another one; connections that break are taken up again, after a wait that grows."""
        wait, tries = FIRST_WAIT, 0
        while after is None or after < end:
            try:
                for frame in self.events(document, after):
                    if frame.kind != "document.snapshot" and after is not None and frame.seq <= after:
                        continue
                    yield frame
                    after, wait, tries = frame.seq, FIRST_WAIT, 0
                    if after >= end:
                        return
            except urllib.error.HTTPError:
                raise
            except OSError:
                pass
            tries += 1
            if tries >= TRIES:
                raise TimeoutError(f"{document} ends at {after}, before {end}")
            time.sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)


class Span(InputPartition):
    def __init__(self, document: str, after: int | None, end: int) -> None:
        super().__init__((document, after, end))


class Reading:
    """What the batch and the streaming reader share: a partition is a document from one cursor to another."""

    def __init__(self, options: dict) -> None:
        self.service = Service(options)

    def read(self, partition: Span) -> Iterator[tuple]:
        document, after, end = partition.value
        for f in self.service.between(document, after, end):
            yield document, f.seq, f.kind, f.data


class LogReader(Reading, DataSourceReader):
    """All events of the documents from the first on."""

    def partitions(self) -> list[Span]:
        return [Span(d, 0, end) for d, end in self.service.heads().items() if end > 0]


class EventReader(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.service.heads()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(d, start.get(d), cursor) for d, cursor in end.items() if d not in start or cursor != start[d]]

    def commit(self, end: dict) -> None:
        pass


class Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docflow_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ``docflow_events`` known to a session."""
    spark.dataSource.register(Events)


def encoded(kind: str, seq: int, data: dict) -> str:
    """An event as a stream has it."""
    return f"event: {kind}\nid: {seq}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"
