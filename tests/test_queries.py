"""Every registered query against its SQL check, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def rows(found):
    return sorted(repr(tuple(row)) for row in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, db):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    ours = rows(found.select(columns).collect())
    if name not in ORACLES:
        assert ours
        return
    result = db.sql(ORACLES[name])
    assert columns == sorted(result.columns)
    assert ours == rows(result.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["path", "language", "decision", "exit_code", "n_errors", "reason"]
    assert found.filter("decision = 'block'").count() > 0
