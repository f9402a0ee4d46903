"""Every query of the core against its SQL, and the entry point."""

import os

import duckdb
import pytest

from cuemill.plans.queries import ORACLE, QUERIES
from tests.conftest import data


@pytest.fixture(scope="module")
def duck():
    folder = data("sf0.001")
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, data("sf0.001"))
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert ours == sorted(repr(tuple(row[i] for i in places)) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, data("sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__

    data("sf0.001")
    assert __spark_entry__.entry(spark).columns == ["source", "chunk_index", "start", "end", "content"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
