"""Every query that has an SQL oracle against it on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(contract.oracle_sql())

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    oracle = duck.sql(contract.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(oracle.columns)
    positions = [oracle.columns.index(c) for c in columns]
    ours = sorted(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    theirs = sorted(tuple(_cell(row[i]) for i in positions) for row in oracle.fetchall())
    assert ours == theirs


def test_every_query_of_the_library_has_an_oracle():
    library = {n for n, fn in contract.queries().items() if fn.__module__.startswith("ionloom.plans")}
    assert library <= set(contract.oracle_sql()) <= set(contract.queries())
