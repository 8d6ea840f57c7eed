"""Every query against its SQL counterpart in DuckDB."""

import glob
import os

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as contract
from traitloom.queries.oracle import ORACLE
from traitloom.queries.registry import QUERIES


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    result = QUERIES[name](spark, TABLES)
    expected = database.execute(ORACLE[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert sorted_rows(result.columns, result.collect()) == sorted_rows(columns, expected.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()
