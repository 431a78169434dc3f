"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from arbograph.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 8)
    return v


def compare(spark, duck, run, sql):
    df = run(spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(repr([normal(r[i]) for i in at]) for r in result.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
