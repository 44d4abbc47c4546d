"""Every query with a DuckDB twin gives its rows on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from oreloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, tables, name):
    got, want = QUERIES[name](spark, SF), tables.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found, at: sorted(repr([plain(r[i]) for i in at]) for r in found)
    assert rows(got.select(*columns).collect(), range(len(columns))) == rows(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
