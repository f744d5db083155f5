import pytest

from graphlaw.llm import queries as Q
from tests.conftest import DATA
from tests.test_catalog import plain

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = Q.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in c.sql(Q.oracle_sql()[name]).select(*columns).fetchall()), key=str)
    assert got == want
