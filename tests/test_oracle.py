"""Every query with an oracle equals its DuckDB SQL on sf0.001 (the driver
repeats this at sf0.01); queries without one must at least run."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from shelfsense.plans.catalog import QUERIES
from shelfsense.plans.oracle import SQL

D = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"property_clusters", "cut_clusters", "cluster_merge_history", "cluster_cuts", "price_smooth_curve"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = df.columns
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
    sql = SQL.get(name)
    if sql is None:
        return
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in rel.description}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == {c: dtypes[c] for c in cols}
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    sold = QUERIES["store_product_sales"](spark, D)
    keys = ["property_code", "category_name", "transaction_month", "description"]
    assert df.count() > 0 and df.join(sold, keys).count() == 0
