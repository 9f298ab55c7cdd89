"""Every registered query with its oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT c_mktsegment, o_orderpriority, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS revenue, count(*) AS n_items
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"""
)
def flagship_segment_revenue(spark, sf_dir):
    """Filter, two equi-joins, grouped aggregation and a total order."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'")
    joined = items.join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    revenue = F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")), 2)
    return joined.groupBy("c_mktsegment", "o_orderpriority").agg(revenue.alias("revenue"), F.count("*").alias("n_items")).orderBy("c_mktsegment", "o_orderpriority")


from . import delta_tables, relational  # noqa: E402, F401  each registers its queries
