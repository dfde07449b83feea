"""Every query of the catalogue against its SQL in DuckDB, and those without SQL for their rows."""

import os

import pytest

from cyclora.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    return con


def shown(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(float(value))
    return str(value)[:10] if hasattr(value, "year") else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(shown, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs_whole(spark, name):
    first, again = (sorted(map(str, catalogue.QUERIES[name](spark, DIR).collect())) for _ in range(2))
    assert first == again
    assert first or name in ("calendar_groups",)
