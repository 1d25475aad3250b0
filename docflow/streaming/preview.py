"""The readers' state as a streaming operator: the same fold as the batch one, kept by document."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import STATE_DDL, Preview, as_row, reduce_event

KEPT = "state string"


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = Preview.restored(json.loads(state.get[0])) if state.exists else Preview()
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.itertuples():
        now = reduce_event(now, int(r.seq), r.kind, json.loads(r.data))
    state.update((json.dumps(now.plain()),))
    yield pd.DataFrame([as_row(key[0], now)], columns=[c.split()[0] for c in STATE_DDL.split(", ")]).astype({"cursor": "Int64"})


def preview_states(events: DataFrame) -> DataFrame:
    """A streaming DataFrame of states from one of events (``document_id, seq, kind, data``)."""
    return events.groupBy("document_id").applyInPandasWithState(fold, STATE_DDL, KEPT, "update", GroupStateTimeout.NoTimeout)


def unseen(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Deliveries once for each receipt key, within a watermark on ``ts`` that bounds the state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["document_id", "source_id"])
