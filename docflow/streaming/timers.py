"""Work that waits for silence, and signs of life at intervals, by timers of stateful streams.

``arrivals`` and ``signs`` have ``worker, ts``. With ``time`` "ProcessingTime" the cluster's clock counts and ``ts`` is only passed on; with "EventTime" timers
go by the watermark, so that a replayed log gives the same rows. The state of a worker is one row and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Silence after which what has come is taken up, and the interval of signs, in milliseconds.
IDLE, EVERY = 30_000, 5_000
BATCHES = "worker string, first timestamp, last timestamp, n long"
BEATS = "worker string, ts timestamp, beats long"


def ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


def stamp(at: int) -> datetime:
    """A time of milliseconds as Spark reads it from a frame (the session's zone is taken for UTC)."""
    return datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None)


class Timed(StatefulProcessor):
    """One state of three numbers and one timer a key."""

    def __init__(self, wait: int, by_event: bool) -> None:
        self.wait, self.by_event = wait, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "first long, last long, n long")

    def close(self) -> None:
        pass

    def times(self, rows: Iterator[pd.DataFrame]) -> list[int]:
        return sorted(ms(t) for frame in rows for t in frame["ts"])

    def now(self, values: object) -> int:
        return values.getCurrentWatermarkInMs() if self.by_event else values.getCurrentProcessingTimeInMs()

    def set_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)


class Gathered(Timed):
    """Arrivals put together until none has come for a while: a later one moves the timer."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out = []
        first, last, n = self.state.get() if self.state.exists() else (None, None, 0)
        for t in self.times(rows):
            if self.by_event and last is not None and t - last >= self.wait:  # the silence lay within what came at once
                out.append((key[0], stamp(first), stamp(last), n))
                first, n = None, 0
            first, last, n = t if first is None else first, t, n + 1
        self.state.update((first, last, n))
        self.set_timer((last if self.by_event else self.now(timerValues)) + self.wait)
        if out:
            yield pd.DataFrame(out, columns=["worker", "first", "last", "n"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        first, last, n = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(key[0], stamp(first), stamp(last), n)], columns=["worker", "first", "last", "n"])


class Beating(Timed):
    """A row at once when a worker shows life, and then one an interval as long as it has done so since the last."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        times = self.times(rows)
        beats, last, fresh = self.state.get() if self.state.exists() else (0, 0, -1)
        if fresh < 0:
            beats, fresh = beats + 1, 0
            self.set_timer((times[0] if self.by_event else self.now(timerValues)) + self.wait)
            yield pd.DataFrame([(key[0], stamp(times[0]), beats)], columns=["worker", "ts", "beats"])
            times = times[1:]
        self.state.update((beats, times[-1] if times else last, fresh + len(times)))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        beats, last, fresh = self.state.get()
        if fresh:
            self.state.update((beats + 1, last, 0))
            self.set_timer(expiredTimerInfo.getExpiryTimeInMs() + self.wait)
            yield pd.DataFrame([(key[0], stamp(last), beats + 1)], columns=["worker", "ts", "beats"])
        else:
            self.state.update((beats, last, -1))


def timed(rows: DataFrame, processor: Timed, ddl: str, time: str) -> DataFrame:
    given = rows.select("worker", F.col("ts").cast("timestamp").alias("ts"))
    given = given.withWatermark("ts", "0 seconds") if time == "EventTime" else given
    return given.groupBy("worker").transformWithStateInPandas(processor, ddl, "Append" if time == "EventTime" else "Update", time)


def work_batches(arrivals: DataFrame, idle: int = IDLE, time: str = "ProcessingTime") -> DataFrame:
    """A streaming DataFrame of ``worker, first, last, n``: arrivals until nothing has come for ``idle`` milliseconds."""
    return timed(arrivals, Gathered(idle, time == "EventTime"), BATCHES, time)


def heartbeats(signs: DataFrame, every: int = EVERY, time: str = "ProcessingTime") -> DataFrame:
    """A streaming DataFrame of ``worker, ts, beats``: the last sign of each worker, an interval of ``every`` milliseconds apart."""
    return timed(signs, Beating(every, time == "EventTime"), BEATS, time)
