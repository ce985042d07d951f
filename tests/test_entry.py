"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from massspark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v) if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(norm, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(norm, r)) for r in want.select(*columns).fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLE_SQL) <= set(entry.oracle_sql())
