import os

import duckdb
import pytest
from gridloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + ('/*.parquet' if os.path.isdir(path) else '')}'")
    return con


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_norm(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    prices = [r.o_totalprice for r in rows]
    assert prices and prices == sorted(prices, reverse=True) and {r.o_orderstatus for r in rows} == {"F"}
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
