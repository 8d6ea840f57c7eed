"""Every training-data query that SQL can express against DuckDB, on whole small tables."""

import glob
import os

import duckdb
import pytest

from llm_fixtures import TABLES

from traitloom.llm.queries import LLM_ORACLE, LLM_QUERIES


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", LLM_ORACLE)
def test_query(spark, database, name):
    result = LLM_QUERIES[name](spark, TABLES)
    expected = database.execute(LLM_ORACLE[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    order = [columns.index(name) for name in result.columns]
    rows = [tuple(row[i] for i in order) for row in expected.fetchall()]
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(rows, key=repr)
