"""Every registered query with SQL, run in Spark and in DuckDB."""

import math

import duckdb
import pytest

from tarn.plans import catalog, definitions, scalars  # noqa: F401  these register their queries
from tarn.session import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, float(v))
    return (3, str(v))


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (x[0] == y[0] == 2 and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
