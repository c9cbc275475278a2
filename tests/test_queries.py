"""Every registered query against its DuckDB statement, value by value."""

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/sf0.001/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted((tuple(row) for row in rows), key=lambda row: [(value is None, repr(value)) for value in row])


def test_every_query_has_a_statement():
    assert {*entry.portfolio_queries(), *entry.stored_queries()} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted({**entry.portfolio_queries(), **entry.stored_queries()}))
def test_query(spark, database, name):
    actual = entry.queries()[name](spark, f"{TESTDATA}/sf0.001")
    expected = database.sql(entry.oracle_sql()[name])
    columns = sorted(actual.columns)
    assert columns == sorted(expected.columns)
    assert {c: TYPES[t] for c, t in actual.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    expected = ordered(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert ordered(actual.select(columns).collect()) == expected


def test_trials_leave_nothing(spark):
    assert not [r for r in spark.sql("SHOW DATABASES").collect() if r[0].startswith("trial_")]


def test_entry(spark):
    assert [r.RISK_CATEGORY for r in entry.entry(spark).collect()] == ["High Risk", "Medium Risk", "Low Risk"]
