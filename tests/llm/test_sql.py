"""The operators that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from driftlog.llm import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(relation.select(*columns).fetchall(), key=repr)
