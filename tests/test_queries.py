"""Every registered query against its oracle on the smallest tables, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as contract
from workload import registry
from workload.check import TABLES, rows

# the training-data queries, where there are any, have tests of their own
QUERIES = {name: fn for name, fn in contract.queries().items() if name in registry.QUERIES}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(QUERIES) == set(registry.QUERIES)
    df = contract.entry(spark)
    assert df.columns == ["vendor", "total_amount", "n_invoices"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
