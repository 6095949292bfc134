"""Every registered query that has SQL gives what DuckDB gives."""

import duckdb
import pytest
from pulseloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = ("events",)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(map(str, map(tuple, df.select(*cols).collect())))
    assert got == sorted(map(str, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(queries.SQL) <= set(__spark_entry__.queries())
