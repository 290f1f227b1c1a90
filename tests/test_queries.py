"""Every registered query against its DuckDB text on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry
from barline.plans.catalog import QUERIES, SQL
from check import normalised

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(FOLDER)):
        connection.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ours = normalised(QUERIES[name](spark, FOLDER).toPandas())
    assert len(ours)
    if name in SQL:
        theirs = normalised(duck.sql(SQL[name]).df())
        assert list(ours.columns) == list(theirs.columns)
        assert ours.equals(theirs)


def test_entry(spark):
    assert not entry(spark).isEmpty()
