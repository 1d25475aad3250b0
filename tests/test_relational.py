"""Every query with SQL gives the same rows in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from docflow.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_rows_equal(spark, db, name):
    got, want = oracle.compare(catalog.QUERIES[name](spark, SF), db, catalog.ORACLES[name])
    assert got == want


def test_flagship_counts(spark):
    rows = entry.entry(spark).collect()
    assert (len(rows), sum(r["n_ids"] for r in rows)) == (9, 19)
