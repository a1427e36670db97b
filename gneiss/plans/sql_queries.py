"""Queries through the SQL facade: the same statement runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import sqlfacade
from gneiss.plans.base import ORACLE, QUERIES, load, query

STATEMENTS = {
    "sql_join_agg": "SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_left_join": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "sql_semi_anti": "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)",
    "sql_full_join": "SELECT coalesce(c_nationkey, s_nationkey) AS k, c, s FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS c FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS s FROM supplier GROUP BY s_nationkey) b ON c_nationkey = s_nationkey",
    "sql_window_topk": "SELECT o_custkey, o_orderkey, CAST(k AS BIGINT) AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2",
    "sql_setops": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3",
    "sql_rollup": "SELECT coalesce(l_returnflag, '*') AS f, coalesce(l_linestatus, '*') AS s, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT coalesce(o_orderstatus, '*') AS s, coalesce(o_orderpriority, '*') AS p, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_subquery": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "sql_running_total": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "sql_distinct_agg": "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag",
    "sql_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
}


def _statement(name: str, sql: str) -> None:
    tables = tuple(t for t in sqlfacade.TABLES if f" {t}" in f" {sql}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sqlfacade.register(spark, sf_dir, tables)
        return spark.sql(sql)  # the whole result; select() adds the facade's limit

    run.__name__ = name
    QUERIES[name], ORACLE[name] = run, sql


for _name, _sql in STATEMENTS.items():
    _statement(_name, _sql)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def sql_limit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ6: a SELECT without a limit gets one."""
    sqlfacade.register(spark, sf_dir, ("nation",))
    return sqlfacade.select(spark, "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey;", 7)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, left(c_name, 10) AS c_name FROM customer ORDER BY customer.c_custkey DESC LIMIT 100")
def sql_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ6: cells as text, cut."""
    sqlfacade.register(spark, sf_dir, ("customer",))
    return sqlfacade.display(sqlfacade.select(spark, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC"), 10)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, left(c_name, 10) AS c_name FROM customer ORDER BY customer.c_custkey LIMIT 100")
def sql_display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ6: the first rows of a whole table, by the facade's own limit."""
    sqlfacade.register(spark, sf_dir, ("customer",))
    return sqlfacade.display(sqlfacade.select(spark, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"), 10)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in sqlfacade.TABLES))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ4."""
    from functools import reduce

    one = [load(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in sqlfacade.TABLES]
    return reduce(DataFrame.unionByName, one)


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT[]": "array<float>", "TIMESTAMP": "timestamp_ntz"}
SCHEMA_TABLES = sqlfacade.TABLES


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name AS col, CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + f" ELSE lower(column_type) END AS type FROM (DESCRIBE {t})" for t in SCHEMA_TABLES))
def table_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ2, SQ3: tables with their columns and types, from the catalog."""
    rows = []
    sqlfacade.register(spark, sf_dir, SCHEMA_TABLES)
    for t in SCHEMA_TABLES:
        rows += [(t, c.name, c.dataType) for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "table_name string, col string, type string")
