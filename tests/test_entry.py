"""Every query of the core engine against its SQL on the smallest tables."""

import datetime
import decimal
import os

import pytest

from perusal.plans import catalogue, payloads  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: str(v) if isinstance(v, (datetime.date, decimal.Decimal)) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name])
        assert mine == rows([c[0] for c in want.description], want.fetchall())
    assert mine


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(__spark_entry__.queries())
