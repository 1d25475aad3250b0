"""Sinks: exports with their digests, exclusive publication, idempotent upserts, templates."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .versions import Change, table

PLACEHOLDER = re.compile(r"@[A-Z_]+@")


def pretty(value) -> str:
    """Indented JSON, other scripts as they are, one line end at the end."""
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


def publish(df: DataFrame, path: str) -> None:
    """Written once: of several writers one gets through, for the others it is a :class:`Conflict` and nothing changes."""
    change = Change(df.sparkSession, path, after=0)
    change.replace("rows", df)
    change.commit()


def export(df: DataFrame, path: str, expected: int) -> int:
    """``df`` in place of version ``expected`` (0: none) of an export; gives its own version, which the next export expects. A
    :class:`Conflict` if the last version is another; readers see the old or the new rows whole."""
    change = Change(df.sparkSession, path, after=expected)
    change.replace("rows", df)
    return change.commit()


def exported(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a published or exported table, of the last version or an earlier one."""
    return table(spark, path, "rows", schema, version)


def merged(existing: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row of each key: the state after an upsert, the same if changes come twice."""
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    return existing.unionByName(changes).withColumn("rank of key", r).filter(F.col("rank of key") == 1).drop("rank of key")


def filled(template: str, values: dict[str, str]) -> str:
    """A template with its placeholders filled; one that is left is an error."""
    made = PLACEHOLDER.sub(lambda m: values.get(m[0].strip("@"), m[0]), template)
    if left := PLACEHOLDER.search(made):
        raise ValueError(f"no value for {left[0]}")
    return made


def filled_column(template: str, values: dict[str, Column]) -> Column:
    """The same for each row: values are columns."""
    parts = re.split(r"(@[A-Z_]+@)", template)
    if left := [p for p in parts if PLACEHOLDER.fullmatch(p) and p.strip("@") not in values]:
        raise ValueError(f"no value for {left[0]}")
    return F.concat(*(values[p.strip("@")] if PLACEHOLDER.fullmatch(p) else F.lit(p) for p in parts))
