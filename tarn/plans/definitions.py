"""Queries over definitions (types, generated columns, referential actions, functions), beside DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import ddl, dml
from tarn.plans.catalog import query
from tarn.session import Tables

SEGMENT = ddl.Enum("segment", ("MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"))
_PLACE = "list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE'], c_mktsegment)"


@query("ddl_enum", f"SELECT c_custkey, CAST({_PLACE} AS BIGINT) AS place, CAST(sign({_PLACE} - 3) AS INTEGER) AS cmp, 'MACHINERY' AS first, 'AUTOMOBILE' AS last, 'BUILDING,HOUSEHOLD,FURNITURE' AS some_of FROM {{customer}}")
def _(t: Tables) -> DataFrame:
    x = F.col("c_mktsegment")
    return t.customer.select("c_custkey", SEGMENT.place(SEGMENT.cast(x)).alias("place"), SEGMENT.compare(x, F.lit("HOUSEHOLD")).alias("cmp"), SEGMENT.first().alias("first"), SEGMENT.last().alias("last"), F.array_join(SEGMENT.range("BUILDING", "FURNITURE"), ",").alias("some_of"))


@query("ddl_enum_order", f"SELECT c_mktsegment, row_number() OVER (ORDER BY min({_PLACE})) AS r, count(*) AS n FROM {{customer}} GROUP BY c_mktsegment")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return rows.withColumn("r", F.row_number().over(Window.orderBy(SEGMENT.place(F.col("c_mktsegment"))))).select("c_mktsegment", "r", "n")


@query("ddl_domain", "SELECT p_partkey, CAST(p_size AS INTEGER) AS s FROM {part}")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", ddl.Domain("size", "int", lambda v: v.between(1, 50), not_null=True).cast(F.col("p_size")).alias("s"))


@query("ddl_generated", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem}")
def _(t: Tables) -> DataFrame:
    return ddl.generated(t.lineitem, net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).select("l_orderkey", "l_linenumber", "net")


@query("ddl_identity", "SELECT count(*) AS n, count(*) AS different, CAST(100 AS BIGINT) AS low, CAST(100 + 5 * (count(*) - 1) AS BIGINT) AS high FROM {orders}")
def _(t: Tables) -> DataFrame:
    out = ddl.identity(t.orders, "id", 100, 5)
    return out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("ddl_alter", "SELECT s_suppkey AS k, CAST(round(s_acctbal) AS BIGINT) AS bal, 'new' AS tag FROM {supplier}")
def _(t: Tables) -> DataFrame:
    df = ddl.add_column(t.supplier, "tag", "string", F.lit("new"))
    df = ddl.alter_type(df, "s_acctbal", "bigint", F.round("s_acctbal"))
    return ddl.drop_column(df, "s_name", "s_nationkey").withColumnsRenamed({"s_suppkey": "k", "s_acctbal": "bal"})


@query("ddl_create_as", "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY o_custkey")
def _(t: Tables) -> DataFrame:
    spark = t.orders.sparkSession
    t.orders.where("o_totalprice > 100000").createOrReplaceTempView("large_orders")
    return spark.sql("SELECT o_custkey, count(*) AS n FROM large_orders GROUP BY o_custkey")


@query("ddl_like_and_truncate", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, CAST(count(*) AS BIGINT) AS k FROM {nation}")
def _(t: Tables) -> DataFrame:
    empty = ddl.like(t.nation).agg(F.count("*").alias("n"))
    cleared = ddl.truncate(t.region).agg(F.count("*").alias("m"))
    return empty.crossJoin(cleared).crossJoin(dml.insert(ddl.like(t.nation), t.nation).table.agg(F.count("*").alias("k")))


@query("fk_cascade", "SELECT o_orderkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
def _(t: Tables) -> DataFrame:
    return ddl.delete_cascading(t.customer, t.orders, [("c_custkey", "o_custkey")], F.col("c_acctbal") < 0)[1].select("o_orderkey")


@query("fk_set_null", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS o_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return ddl.delete_cascading(t.customer, t.orders, [("c_custkey", "o_custkey")], F.col("c_acctbal") < 0, "set null")[1].select("o_orderkey", "o_custkey")


@query("fk_set_default", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE o_custkey END AS o_custkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    return ddl.delete_cascading(t.customer, t.orders, [("c_custkey", "o_custkey")], F.col("c_acctbal") < 0, "set default", 0)[1].select("o_orderkey", "o_custkey")


@query("cte_modifying", "WITH s AS (SELECT c_custkey * 2 AS k, c_acctbal AS bal FROM {customer}) SELECT count(*) AS n, round(sum(s.bal - s_acctbal), 2) AS moved FROM {supplier} JOIN s ON s_suppkey = s.k")
def _(t: Tables) -> DataFrame:
    target, source = t.supplier.selectExpr("s_suppkey k", "s_acctbal bal"), t.customer.selectExpr("c_custkey * 2 k", "c_acctbal bal")
    changed = dml.update_from(target, source, ["k"], {"bal": F.col("s.bal")}).returning
    return changed.agg(F.count("*").alias("n"), F.round(F.sum(F.col("new.bal") - F.col("old.bal")), 2).alias("moved"))


@query("stmt_prepared", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal > 500 AND n_regionkey = 2 GROUP BY n_name")
def _(t: Tables) -> DataFrame:
    text = "SELECT n_name, count(*) AS n FROM {c} JOIN {n} ON c_nationkey = n_nationkey WHERE c_acctbal > $1 AND n_regionkey = $2 GROUP BY n_name"
    return ddl.Prepared(t.nation.sparkSession, text, c=t.customer, n=t.nation).execute(500, 2)


@query("stmt_cursor", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 30")
def _(t: Tables) -> DataFrame:
    return ddl.fetch(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 15, 30)


@query("func_sql", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem}")
def _(t: Tables) -> DataFrame:
    ddl.sql_function(t.lineitem.sparkSession, "net_price", "price DOUBLE, discount DOUBLE", "DOUBLE", "round(price * (1 - discount), 4)")
    return t.sql("SELECT l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount) AS net FROM {lineitem}")


@query("func_table", "SELECT n_nationkey, x AS step FROM {nation}, (SELECT unnest(range(1, 4)) AS x)")
def _(t: Tables) -> DataFrame:
    ddl.sql_function(t.nation.sparkSession, "steps", "low INT, high INT", "TABLE (step INT)", "SELECT explode(sequence(low, high)) AS step")
    return t.sql("SELECT n_nationkey, CAST(step AS BIGINT) AS step FROM {nation}, LATERAL steps(1, 3)")
