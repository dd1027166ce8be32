"""Every registered query against its reference SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import canonical
from occurra import catalog
from occurra.sources.star import SOURCE_TABLES

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in SOURCE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(names, cursor.fetchall())


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[0] == "compound_qid" and not rows.isEmpty()
