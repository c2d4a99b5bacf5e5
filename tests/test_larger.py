"""Registered queries on tables beyond the driver's, against their SQL in DuckDB."""

import duckdb
from pyspark.sql import functions as F

from tarn.functions import textsearch
from tarn.operators import recursive
from tarn.plans import catalog


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables that are given as DuckDB SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns)
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: [(v is None, v or 0) for v in r])
    return order(got.collect()), order(want.fetchall())


def test_networks_of_keys_over_two_octets(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "fn_network", part="SELECT k AS p_partkey FROM range(1, 140000, 97) AS t(k)")
    assert len(want) == 1444 and got == want


def test_word_statistics_split_each_text_once(spark, tmp_path):
    documents = "SELECT k AS doc_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN ' .. ' ELSE repeat('The cats, the CAT ' || k % 5 || ' ', 1 + k % 3) || k END AS text FROM range(200) AS t(k)"
    got, want = against_sql(spark, tmp_path, "ts_stat", documents=documents)
    assert got == want
    plan = catalog.QUERIES["ts_stat"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_sort(" not in plan
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for config in ("simple", "english"):
        vectors = docs.select(textsearch.ts_stat(textsearch.to_tsvector(F.col("text"), config)).alias("word", "at"))
        by_vector = vectors.groupBy("word").agg(F.count("*").alias("ndoc"), F.sum(F.size("at")).alias("nentry"))
        assert sorted(map(tuple, textsearch.ts_stat_texts(docs, "text", config).collect())) == sorted(map(tuple, by_vector.collect()))


def test_recursion_shuffles_no_edges_in_small_rounds(spark, tmp_path, monkeypatch):
    plans = []
    cut = recursive._cut
    monkeypatch.setattr(recursive, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    lineitem = "SELECT CASE WHEN k % 50 <> 9 THEN k % 300 + 300 * c END AS l_partkey, CASE WHEN k % 70 <> 3 THEN k // 7 % 40 + 40 * c END AS l_suppkey FROM range(900) AS t(k), range(3) AS r(c)"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, want = against_sql(spark, tmp_path, "cte_recursive_union", lineitem=lineitem)
        assert len(plans) > 3 and not [p for p in plans if "hashpartitioning(src" in p]
        monkeypatch.setattr(recursive, "BROADCAST_ROWS", 3)
        again = catalog.QUERIES["cte_recursive_union"](spark, str(tmp_path)).collect()
        assert [p for p in plans if "hashpartitioning(src" in p]  # large rounds still shuffle
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(want) > 40 and got == want
    assert len(again) == len(want) and set(map(tuple, again)) == set(want)
