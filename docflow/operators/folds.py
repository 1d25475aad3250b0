"""Passes over rows in order, many documents a task.

Rows are dealt out by key and sorted, and a task goes through them once, a slice at a time. Against a group of its own for each document
(``applyInPandas``) this saves a table for each, which costs many times what the fold of a short document does; and
memory holds a slice, not all rows of a document.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are turned into Python values, or back, at once; and bytes of text.
ROWS, BYTES = 512, 1 << 20


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows with equal ``keys`` behind each other in one of some tasks for each core, in order; a row's work is more than its bytes tell."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def slices(batches: Iterable[pa.RecordBatch], texts: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of at most ``ROWS`` rows, of which the columns ``texts`` have about ``BYTES``."""
    for batch in batches:
        cost = np.full(batch.num_rows, BYTES // ROWS, np.int64)
        for name in texts:
            cost += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(cost) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start < end:
                yield batch.slice(start, end - start)


def values(batches: Iterable[pa.RecordBatch], texts: tuple[str, ...] = ()) -> Iterator[tuple]:
    """The rows of batches as named tuples."""
    row = None
    for part in slices(batches, texts):
        row = row or namedtuple("Row", part.schema.names)
        yield from map(row, *(c.to_pylist() for c in part.columns))


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    made: list[tuple] = []
    for row in rows:
        made.append(row)
        if len(made) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def in_order(rows: DataFrame, keys: list[str], order: str, fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """The rows that ``fold`` makes of a key and its rows, which come by ``order``."""
    schema, n = arrow_schema(ddl), len(keys)
    rest = [c for c in rows.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(values(batches), lambda row: row[:n])
        return batched((made for key, some in groups for made in fold(key, some)), schema)

    return dealt(rows.select(*keys, *rest), keys, order).mapInArrow(run, ddl)
