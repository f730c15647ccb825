"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from tidewater.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("n", "nan" if math.isnan(v) else f"{float(v):.9g}")
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
