"""Every query of the log engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from driftlog import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return connection


def plain(row):
    return tuple(str(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    relation = duck.sql(queries.SQL[name])
    assert sorted(relation.columns) == columns
    assert got == sorted(plain(r) for r in relation.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
