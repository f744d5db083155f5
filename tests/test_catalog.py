"""Every registered query with SQL equals it on the smallest tables."""

import pytest

from graphlaw.plans import catalog
from tests.conftest import DATA

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(*columns).fetchall()), key=str)
    assert got == want
