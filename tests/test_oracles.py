"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import pytest

from weftline.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else f"{x:.9g}"
        return f"{x:.9g}" if isinstance(x, int) and not isinstance(x, bool) else x

    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    told = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)):
        assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0, name
