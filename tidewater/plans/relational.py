"""Queries over Spark's own operators: projection, filters, arithmetic, joins, aggregates, sorting, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import legacy_add, legacy_cast, legacy_divide, legacy_mod, legacy_multiply, legacy_subtract, legacy_sum
from ..operators import exchange, join, strict_union, typed
from .catalog import query, table

# --- sources and projection -----------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def scan_parquet(spark, sf):
    return table(spark, sf, "nation")


@query("SELECT r_regionkey, r_name FROM region")
def local_rows_scan(spark, sf):
    rows = table(spark, sf, "region").collect()  # five rows
    return spark.createDataFrame(rows, T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())]))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def catalog_relation_scan(spark, sf):
    table(spark, sf, "nation").createOrReplaceTempView("tidewater_nation")
    return spark.table("tidewater_nation").where("n_regionkey = 1").select("n_nationkey", "n_name")


@query("SELECT n_name, n_regionkey FROM nation")
def project(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.col("N_REGIONKEY").alias("n_regionkey"))


@query("SELECT * FROM region")
def project_star(spark, sf):
    return table(spark, sf, "region").select("*")


@query("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def project_qualified_star(spark, sf):
    return table(spark, sf, "nation").alias("n").join(table(spark, sf, "region").alias("r"), F.expr("n.n_regionkey = r.r_regionkey")).select("n.*", "r.r_name")


@query("SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer")
def project_alias(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 2).alias("twice"))


@query("SELECT p_partkey, p_size, p_size + 1 AS next_size FROM part")
def with_column(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").withColumn("next_size", F.col("p_size") + 1)


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation FROM customer")
def nested_struct_field(spark, sf):
    s = F.when(F.col("c_nationkey") != 3, F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("key")).alias("nation")))
    return table(spark, sf, "customer").select("c_custkey", s.alias("s")).select("c_custkey", F.col("s.segment").alias("segment"), F.col("s.nation.key").alias("nation"))


# --- filters and predicates -----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05 AND l_tax <= 0.04 AND l_returnflag = 'R' AND l_linestatus <> 'O'")
def filter_comparison(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").where((c("l_quantity") >= 10) & (c("l_quantity") < 20) & (c("l_discount") > 0.05) & (c("l_tax") <= 0.04) & (c("l_returnflag") == "R") & (c("l_linestatus") != "O")).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, (a AND b) AS a_and_b, (a OR b) AS a_or_b, NOT a AS not_a FROM (SELECT o_orderkey,
    nullif(o_orderstatus, 'P') = 'F' AS a, nullif(o_orderpriority, '5-LOW') = '1-URGENT' AS b FROM orders)""")
def boolean_kleene(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", (F.nullif("o_orderstatus", F.lit("P")) == "F").alias("a"), (F.nullif("o_orderpriority", F.lit("5-LOW")) == "1-URGENT").alias("b"))
    return d.select("o_orderkey", (F.col("a") & F.col("b")).alias("a_and_b"), (F.col("a") | F.col("b")).alias("a_or_b"), (~F.col("a")).alias("not_a"))


@query("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'F' OR nullif(o_orderpriority, '5-LOW') = '1-URGENT')")
def filter_boolean_kleene(spark, sf):
    return table(spark, sf, "orders").where(~((F.nullif("o_orderstatus", F.lit("P")) == "F") | (F.nullif("o_orderpriority", F.lit("5-LOW")) == "1-URGENT"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NULL")
def is_null(spark, sf):
    return table(spark, sf, "part").where(F.nullif("p_size", F.lit(7)).isNull()).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NOT NULL")
def is_not_null(spark, sf):
    return table(spark, sf, "part").where(F.nullif("p_size", F.lit(7)).isNotNull()).select("p_partkey")


@query("SELECT p_partkey, nullif(p_size, 7) IS NOT DISTINCT FROM nullif(p_size, 9) AS same FROM part")
def null_safe_equal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).eqNullSafe(F.nullif("p_size", F.lit(9))).alias("same"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 3 AND c_mktsegment = 'BUILDING'")
def typed_filter(spark, sf):
    return table(spark, sf, "customer").where(typed(lambda r: (r.c_acctbal > 3) & (r.c_mktsegment == "BUILDING"))).select("c_custkey", "c_acctbal")


# --- expressions ----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS plus, l_extendedprice - l_discount AS minus, l_extendedprice * l_discount AS times,
    l_extendedprice / l_quantity AS ratio, l_linenumber % 3 AS modulo, -l_linenumber AS negative FROM lineitem""")
def arithmetic_all(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax")).alias("plus"), (c("l_extendedprice") - c("l_discount")).alias("minus"), (c("l_extendedprice") * c("l_discount")).alias("times"), (c("l_extendedprice") / c("l_quantity")).alias("ratio"), (c("l_linenumber") % 3).alias("modulo"), (-c("l_linenumber")).alias("negative"))


@query("SELECT p_partkey, p_size / 4 AS quarter FROM part")
def integer_division(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 4).alias("quarter"))


@query("SELECT p_partkey, p_size % 7 AS m, -p_size % 7 AS negative_m FROM part")
def modulo(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7).alias("m"), ((-F.col("p_size")) % 7).alias("negative_m"))


@query("""SELECT l_orderkey, l_linenumber, CAST(a + b AS DECIMAL(11,2)) AS plus, CAST(a - b AS DECIMAL(11,2)) AS minus, CAST(a * b AS DECIMAL(21,4)) AS times FROM
    (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10,2)) AS a, CAST(l_quantity AS DECIMAL(10,2)) AS b FROM lineitem)""")
def decimal_arithmetic(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(10,2)").alias("a"), F.col("l_quantity").cast("decimal(10,2)").alias("b"))
    return d.select("l_orderkey", "l_linenumber", (F.col("a") + F.col("b")).alias("plus"), (F.col("a") - F.col("b")).alias("minus"), (F.col("a") * F.col("b")).alias("times"))


@query("""SELECT l_orderkey, l_linenumber, CAST(a AS DOUBLE) / 8 AS ratio, CAST(a % b AS DECIMAL(10,2)) AS rest FROM
    (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(10,2)) AS a, CAST(l_quantity AS DECIMAL(10,2)) AS b FROM lineitem)""")
def decimal_divide_modulo(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(10,2)").alias("a"), F.col("l_quantity").cast("decimal(10,2)").alias("b"))
    return d.select("l_orderkey", "l_linenumber", (F.col("a") / F.lit(8).cast("decimal(10,0)")).cast("double").alias("ratio"), (F.col("a") % F.col("b")).alias("rest"))


@query("""SELECT p_partkey, CASE WHEN p_size + 2147483620 <= 2147483647 THEN CAST(p_size + 2147483620 AS INTEGER) END AS plus,
    CASE WHEN p_size * 100000000 <= 2147483647 THEN CAST(p_size * 100000000 AS INTEGER) END AS times, CASE WHEN p_size % 5 <> 0 THEN p_size / (p_size % 5) END AS ratio,
    CASE WHEN p_size % 5 <> 0 THEN p_size % (p_size % 5) END AS rest, CASE WHEN p_size * 1e8 < 2147483648 THEN CAST(p_size * 100000000 AS INTEGER) END AS narrow,
    CASE WHEN -2147483620 - p_size >= -2147483648 THEN CAST(-2147483620 - p_size AS INTEGER) END AS minus FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def legacy_overflow_null(spark, sf):
    """Legacy mode: overflow, division by zero and impossible casts are null, not wrapped or saturated."""
    n = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", legacy_add(n, F.lit(2147483620)).alias("plus"), legacy_multiply(n, F.lit(100000000)).alias("times"), legacy_divide(n, n % 5).alias("ratio"),
        legacy_mod(n, n % 5).cast("long").alias("rest"), legacy_cast(n * F.lit(1e8), "int").alias("narrow"), legacy_subtract(F.lit(-2147483620), n).alias("minus"),
    )


@query("SELECT CAST(NULL AS BIGINT) AS overflow, CAST(sum(p_size) AS BIGINT) AS fits FROM part")
def legacy_sum_overflow_null(spark, sf):
    return table(spark, sf, "part").agg(legacy_sum(F.lit(9223372036854775000)).alias("overflow"), legacy_sum("p_size").alias("fits"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS class,
    CASE WHEN o_orderstatus = 'F' THEN 1 END AS done, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE o_totalprice END AS widest FROM orders""")
def case_when(spark, sf):
    c = F.col
    return table(spark, sf, "orders").select("o_orderkey", F.when(c("o_totalprice") > 200000, "large").when(c("o_totalprice") > 100000, "medium").otherwise("small").alias("class"), F.when(c("o_orderstatus") == "F", 1).alias("done"), F.when(c("o_orderstatus") == "F", 1).otherwise(c("o_totalprice")).alias("widest"))


@query("SELECT r_regionkey, true AS b, CAST(5 AS BIGINT) AS l, 1.5::DOUBLE AS d, 'it''s' AS s, DATE '2020-02-29' AS dt, TIMESTAMP '2020-02-29 12:34:56' AS ts, CAST(1.25 AS DECIMAL(5,2)) AS dec, CAST(NULL AS INTEGER) AS nothing FROM region")
def literals(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.lit(True).alias("b"), F.lit(5).cast("long").alias("l"), F.lit(1.5).alias("d"), F.lit("it's").alias("s"), F.expr("date'2020-02-29'").alias("dt"), F.expr("timestamp_ntz'2020-02-29 12:34:56'").alias("ts"), F.expr("cast(1.25 as decimal(5,2))").alias("dec"), F.lit(None).cast("int").alias("nothing"))


@query("""SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS DOUBLE) AS wide, CAST(l_linenumber AS DECIMAL(12,2)) AS dec,
    l_linenumber <> 0 AS flag, CAST(l_shipdate AS DATE) AS day FROM lineitem""")
def casts(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_extendedprice").cast("long").alias("whole"), c("l_linenumber").cast("double").alias("wide"), c("l_linenumber").cast("decimal(12,2)").alias("dec"), c("l_linenumber").cast("boolean").alias("flag"), c("l_shipdate").cast("date").alias("day"))


# --- joins ----------------------------------------------------------------------------------------------------------

_FINISHED = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')"
_BUILDERS = "(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')"


def _sides(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")


def _equi(kind: str, sql: str):
    def run(spark, sf):
        a, b = _sides(spark, sf)
        return join(a, b, a.c_custkey == b.o_custkey, kind)

    return query(sql, f"join_{sql_name(kind)}")(run)


def sql_name(kind: str) -> str:
    return kind.lower().replace("leftsemi", "semi").replace("left_anti", "anti").replace("full outer", "full").replace("leftouter", "left").replace("right_outer", "right")


join_inner = _equi("inner", f"SELECT * FROM {_BUILDERS} JOIN {_FINISHED} ON c_custkey = o_custkey")
join_left = _equi("leftouter", f"SELECT * FROM {_BUILDERS} LEFT JOIN {_FINISHED} ON c_custkey = o_custkey")
join_right = _equi("right_outer", f"SELECT * FROM {_BUILDERS} RIGHT JOIN {_FINISHED} ON c_custkey = o_custkey")
join_full = _equi("FULL OUTER", f"SELECT * FROM {_BUILDERS} FULL JOIN {_FINISHED} ON c_custkey = o_custkey")
join_semi = _equi("leftsemi", f"SELECT * FROM {_BUILDERS} WHERE c_custkey IN (SELECT o_custkey FROM {_FINISHED})")
join_anti = _equi("left_anti", f"SELECT * FROM {_BUILDERS} WHERE c_custkey NOT IN (SELECT o_custkey FROM {_FINISHED})")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R'")
def join_multi_key(spark, sf):
    a, b = table(spark, sf, "lineitem").where("l_returnflag = 'R'").alias("a"), table(spark, sf, "lineitem").alias("b")
    return join(a, b, F.expr("a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")).select("a.l_orderkey", "a.l_linenumber", "b.l_quantity")


@query("""SELECT k, n_name, r_name FROM (SELECT nullif(n_regionkey, 2) AS k, n_name FROM nation) FULL JOIN (SELECT nullif(r_regionkey, 3) AS j, r_name FROM region) ON k = j""")
def join_null_keys(spark, sf):
    a, b = table(spark, sf, "nation").select(F.nullif("n_regionkey", F.lit(2)).alias("k"), "n_name"), table(spark, sf, "region").select(F.nullif("r_regionkey", F.lit(3)).alias("j"), "r_name")
    return join(a, b, F.col("k") == F.col("j"), "outer").drop("j")


@query("SELECT key, n_name, r_name FROM (SELECT n_regionkey AS key, n_name FROM nation) JOIN (SELECT r_regionkey AS key, r_name FROM region) USING (key)")
def join_using(spark, sf):
    return join(table(spark, sf, "nation").select(F.col("n_regionkey").alias("key"), "n_name"), table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), "r_name"), ["key"])


@query("SELECT * FROM (SELECT n_regionkey AS key, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS key, r_name FROM region)")
def join_natural(spark, sf):
    return spark.sql("SELECT * FROM (SELECT n_regionkey AS key, n_name FROM {n}) NATURAL JOIN (SELECT r_regionkey AS key, r_name FROM {r})", n=table(spark, sf, "nation"), r=table(spark, sf, "region"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return join(table(spark, sf, "region"), table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf):
    a, b = table(spark, sf, "nation").alias("a"), table(spark, sf, "nation").alias("b")
    return join(a, b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, min(l_shipdate) AS first, max(l_extendedprice) AS most FROM lineitem")
def agg_global(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_extendedprice").alias("most"))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_shipdate) AS first FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.min("l_shipdate").alias("first"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY 1")
def agg_group_empty(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity < 0").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE), 2) AS price, count(*) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2""")
def agg_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double"), 2).alias("price"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def agg_group_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").count()


@query("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n, count(nullif(o_orderpriority, '5-LOW')) AS n_priority FROM orders GROUP BY 1")
def agg_null_group(spark, sf):
    return table(spark, sf, "orders").groupBy(F.nullif("o_orderstatus", F.lit("F")).alias("status")).agg(F.count("*").alias("n"), F.count(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("n_priority"))


@query("SELECT count(*) AS all_rows, count(nullif(p_size, 7)) AS some_rows, count(1) AS ones FROM part")
def agg_count_star_vs_col(spark, sf):
    return table(spark, sf, "part").agg(F.count("*").alias("all_rows"), F.count(F.nullif("p_size", F.lit(7))).alias("some_rows"), F.count(F.lit(1)).alias("ones"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_suppkey", "l_linenumber").alias("pairs"), F.sum_distinct("l_linenumber").alias("numbers"))


@query("SELECT l_returnflag, round(CAST(sum(CAST(l_discount AS DECIMAL(5,2))) AS DOUBLE) / count(*), 6) AS mean FROM lineitem GROUP BY 1")
def agg_avg_decimal(spark, sf):
    """avg(decimal(5,2)) is decimal(9,6)."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_discount").cast("decimal(5,2)")).cast("double"), 6).alias("mean"))


@query("SELECT l_linestatus, CAST(sum(CAST(l_tax AS DECIMAL(5,2))) AS DECIMAL(15,2)) AS total FROM lineitem GROUP BY 1")
def agg_sum_decimal(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.sum(F.col("l_tax").cast("decimal(5,2)")).alias("total"))


@query("SELECT min(o_orderkey) AS a, max(o_orderpriority) AS b, min(o_orderdate) AS c, max(CAST(o_orderdate AS DATE)) AS d, min(o_totalprice) AS e, max(CAST(o_totalprice AS DECIMAL(12,2))) AS f, max(o_orderstatus = 'F') AS g FROM orders")
def agg_min_max_types(spark, sf):
    c = F.col
    return table(spark, sf, "orders").agg(F.min("o_orderkey").alias("a"), F.max("o_orderpriority").alias("b"), F.min("o_orderdate").alias("c"), F.max(c("o_orderdate").cast("date")).alias("d"), F.min("o_totalprice").alias("e"), F.max(c("o_totalprice").cast("decimal(12,2)")).alias("f"), F.max(c("o_orderstatus") == "F").alias("g"))


@query("SELECT l_returnflag, round(sum(l_linenumber) / count(*), 6) AS per_row, max(l_linenumber) - min(l_linenumber) AS spread FROM lineitem GROUP BY 1")
def agg_expression(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_linenumber") / F.count("*"), 6).alias("per_row"), (F.max("l_linenumber") - F.min("l_linenumber")).alias("spread"))


@query("SELECT CAST(k AS DOUBLE) AS k, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE CASE WHEN p_size % 2 = 0 THEN -0.0::DOUBLE ELSE 0.0::DOUBLE END END + 0.0 AS k FROM part) GROUP BY 1")
def agg_nan_and_negative_zero(spark, sf):
    """NaN is one group, and -0.0 is in that of 0.0."""
    k = F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).when(F.col("p_size") % 3 == 1, F.lit(0.0)).otherwise(F.when(F.col("p_size") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)))
    return table(spark, sf, "part").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


# --- sorting, limits, sets ------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, nullif(s_nationkey, 5) AS nation FROM supplier ORDER BY nation ASC NULLS FIRST, s_suppkey")
def sort_asc_nulls_first(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(5)).alias("nation")).orderBy(F.asc("nation"), "s_suppkey")


@query("SELECT s_suppkey, nullif(s_nationkey, 5) AS nation FROM supplier ORDER BY nation DESC NULLS LAST, s_suppkey")
def sort_desc_nulls_last(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(5)).alias("nation")).orderBy(F.desc("nation"), "s_suppkey")


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC, p_size DESC, p_partkey")
def sort_multi(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_size").orderBy(F.asc("p_brand"), F.desc("p_size"), "p_partkey")


@query("SELECT s_suppkey, nullif(s_nationkey, 5) AS nation FROM supplier ORDER BY nation ASC NULLS LAST, s_suppkey DESC")
def sort_explicit_nulls(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(5)).alias("nation")).orderBy(F.asc_nulls_last("nation"), F.desc_nulls_first("s_suppkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def limit_after_sort(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def union_all(spark, sf):
    r = table(spark, sf, "region").select("r_name")
    return strict_union(strict_union(table(spark, sf, "nation").select(F.col("n_name").alias("name")), r), r)


@query("SELECT o_orderkey, o_custkey FROM orders")
def repartition_hash(spark, sf):
    return exchange(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 5, "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders")
def repartition_round_robin(spark, sf):
    return exchange(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 5)


# --- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, trim('  ' || c_name || ' ') AS t, upper(CAST(c_custkey AS VARCHAR)) AS n FROM customer")
def fn_upper_lower_trim(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_name").alias("l"), F.trim(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("t"), F.upper(F.col("c_custkey").cast("string")).alias("n"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS letters, CAST(strlen(text) AS INTEGER) AS bytes FROM documents")
def fn_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("letters"), F.length(F.col("text").cast("binary")).alias("bytes"))


@query("SELECT c_custkey, c_name || '/' || CAST(c_nationkey AS VARCHAR) AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b FROM customer")
def fn_concat(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit("/"), F.col("c_nationkey").cast("string")).alias("a"), F.concat("c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("b"))


@query("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), c_custkey) AS a, coalesce(nullif(c_nationkey, 3), CAST(0.5 AS DOUBLE)) AS b FROM customer")
def fn_coalesce(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(3)), "c_custkey").alias("a"), F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(0.5)).alias("b"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d FROM events")
def fn_date_parts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS b FROM orders")
def fn_to_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("b"))


@query("SELECT r_regionkey, true AS ok FROM region")
def fn_current_date_timestamp(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", (F.current_date().isNotNull() & (F.current_timestamp() >= F.current_date().cast("timestamp"))).alias("ok"))


# --- SQL ------------------------------------------------------------------------------------------------------------

_SQL = "SELECT l_orderkey, `l_linenumber`, l_quantity * 2 + 1 AS q, 'it''s' AS s /* a comment */ FROM {t} WHERE (l_quantity > 10 AND NOT l_returnflag = 'N') OR l_tax = 0.08 -- the end"


@query("SELECT n.n_name, r.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey <> 3")
def sql_door_star(spark, sf):
    return spark.sql("SELECT n.n_name, r.* FROM {n} n JOIN {r} r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey <> 3", n=table(spark, sf, "nation"), r=table(spark, sf, "region"))


@query("SELECT o_custkey, o_orderkey, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def join_type_aliases(spark, sf):
    """The same join under each of its names: what one has and another lacks would be seen as rows too many."""
    a, b = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    kinds = [join(a, b, a.o_custkey == b.c_custkey, kind) for kind in ("left", "leftouter", "left_outer", "LEFT OUTER")]
    out = kinds[0]
    for other in kinds[1:]:
        out = out.unionAll(other.exceptAll(kinds[0])).unionAll(kinds[0].exceptAll(other))
    return out


@query(_SQL.replace("{t}", "lineitem").replace("`", '"'))
def sql_door_select_where(spark, sf):
    return spark.sql(_SQL, t=table(spark, sf, "lineitem"))
