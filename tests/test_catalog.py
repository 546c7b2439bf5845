"""Registered queries of the gates, reports and metrics against their SQL, on the smallest tables."""

import duckdb
import pytest

from gatewright.plans import catalog, front_catalog, json_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "nation customer part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda x: repr(float(f"{x:.9g}")) if isinstance(x, float) else repr(x)
    return [cols[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = con.execute(catalog.SQL[name])
    assert got == rows([x[0] for x in cur.description], cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
