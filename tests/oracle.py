"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canonical(row[i]) for i in order) for row in values)


def compare(spark_df, db, sql: str):
    """The two results as sorted column names and rows."""
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = db.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    return got, want
