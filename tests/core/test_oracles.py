"""Each query beside its SQL on the smallest tables."""

import os

import duckdb
import pytest

from memlake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    said = duck.execute(catalogue.oracle_sql()[name])
    order = [c[0] for c in said.description]
    assert sorted(order) == cols
    want = sorted(repr([plain(r[order.index(c)]) for c in cols]) for r in said.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_every_query_without_sql_gives_rows(spark):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        assert catalogue.queries()[name](spark, DATA).count() >= 1
