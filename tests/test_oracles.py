"""Every registered query with an SQL form gives the same rows and types in DuckDB."""

import duckdb
import pytest
from conftest import SF

from galewise.plans.registry import all_oracles, all_queries

TABLES = "customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(table):
    table = table.select(sorted(table.column_names))
    rows = zip(*[c.to_pylist() for c in table.columns])
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, duck, name):
    got = all_queries()[name](spark, SF).toArrow()
    want = duck.sql(all_oracles()[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert _rows(got) == _rows(want)


def test_every_query_is_registered_once():
    assert set(all_oracles()) <= set(all_queries())
