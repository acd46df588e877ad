"""Every query with SQL agrees with it at the smallest scale; the others run and give rows of a stable schema."""

import duckdb
import pytest

from textkraal.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(r)) for r in df.collect())
    if name in SQL:
        r = con.sql(SQL[name])
        at = [r.columns.index(c) for c in df.columns]
        assert rows == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
    assert len(set(df.columns)) == len(df.columns)


def test_catalog_has_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
