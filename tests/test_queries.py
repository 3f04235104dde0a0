"""Every registered query against its DuckDB twin on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tests.conftest import plan

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(entry.catalog.QUERIES), dict(entry.oracles.SQL)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert "CartesianProduct" not in plan(got) and "NestedLoopJoin" not in plan(got)
    assert check.rows(got.columns, got.collect()) == check.rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_the_entry_imports_without_the_jars_of_spark(tmp_path):
    """Another process may hold Spark elsewhere: importing must not look into its files."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    script = tmp_path / "probe.py"
    script.write_text(
        "import builtins, glob\n"
        "real = builtins.open\n"
        "def closed(path, *a, **k):\n"
        "    assert 'jars' not in str(path), path\n"
        "    return real(path, *a, **k)\n"
        "builtins.open = closed\n"
        "glob.glob = lambda *a, **k: []\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()) >= 70, len(e.oracle_sql()) >= 70)\n"
    )
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True,
                          cwd=str(tmp_path), env=os.environ | {"PYTHONPATH": root})
    assert done.stdout.split() == ["True", "True"], done.stderr

