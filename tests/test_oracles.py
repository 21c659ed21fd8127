"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pitchspark.plans import ORACLE_SQL, QUERIES, runner

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if isinstance(value, (bool, str)):
        return value
    return round(float(value), 6)


def rows(frame):
    return sorted((tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, db, name):
    ours, theirs = runner(QUERIES[name])(spark, FOLDER).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert runner(QUERIES[name])(spark, FOLDER).count() > 0


def test_entry_needs_no_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["user_id", "a", "b", "p", "break_even"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
