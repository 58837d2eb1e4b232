"""Every registered query with oracle SQL gives the oracle's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry
from gleaner.catalog import all_queries
from gleaner.catalog.base import TABLES
from tools.check import canonical

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("query", all_queries(), ids=lambda q: q.name)
def test_query(spark, con, query):
    got = query.run(spark, SF_DIR).toPandas()
    if query.sql is None:
        assert len(got) > 0
        return
    want = con.execute(query.sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry(spark).count() > 0
