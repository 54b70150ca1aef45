"""Every query with SQL gives the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(names, rows):
    order = [names.index(name) for name in sorted(names)]
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    found = comparable(result.columns, result.collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert found == comparable(names, cursor.fetchall())


def test_entry_is_sorted(spark):
    result = contract.entry(spark).collect()
    assert result
    assert [r.o_orderdate for r in result] == sorted((r.o_orderdate for r in result), reverse=True)
