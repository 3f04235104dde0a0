"""Every query of this part that has a DuckDB twin, and the schemas of all."""

import duckdb
import pytest

import check
from folioscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.SQL))
def test_twin(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    result = db.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert check.rows(got.columns, got.collect()) == check.rows(columns, result.fetchall())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
