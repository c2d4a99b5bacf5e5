"""Queries with SQL, run in Spark and in DuckDB."""

import pytest

from tarn.llm import queries
from tests.test_catalog import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_all_run(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
