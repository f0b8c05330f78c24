"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from orthant.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test data not here")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    import duckdb

    own = QUERIES[name](spark, SMALL)
    rows = own.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("embeddings", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        expected = con.execute(ORACLES[name])
        order, names = [d[0] for d in expected.description], sorted(own.columns)
        assert sorted(order) == names
        other = [tuple(r[order.index(c)] for c in names) for r in expected.fetchall()]
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows))) == sorted(map(repr, other))


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 10
    assert set(driver.oracle_sql()) <= set(driver.queries())
