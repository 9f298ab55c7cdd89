import time

import pytest
from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import functions as F

from tidewater import session
from tidewater.functions import legacy_add, legacy_cast, legacy_divide, legacy_sum
from tidewater.operators import exchange, join, strict_union, typed
from tidewater.operators.relational import join_type
from tidewater.sources import MEMORY, read, time_travel, write


def test_session_defaults_and_conf(spark):
    s = session.session(config={"tidewater.some.key": "1"})
    assert s.conf.get("spark.sql.session.timeZone") == "UTC" and s.conf.get("tidewater.some.key") == "1"
    with session.ansi(s, False):
        assert s.conf.get("spark.sql.ansi.enabled") == "false"
        assert s.range(1).select(F.lit(1) / F.lit(0)).first()[0] is None
    with pytest.raises(ArithmeticException):
        s.range(1).select(F.lit(1) / F.lit(0)).collect()


def test_legacy_is_null_in_either_mode(spark):
    for on in (True, False):
        with session.ansi(spark, on):
            row = spark.range(1).select(legacy_add(F.lit(2147483647), F.lit(1)), legacy_divide(F.lit(1), F.lit(0)), legacy_cast(F.lit(1e300), "int"), legacy_cast(F.lit(float("nan")), "long")).first()
            assert list(row) == [None] * 4
            assert spark.createDataFrame([(2**63 - 1,), (1,)], "v long").agg(legacy_sum("v")).first()[0] is None


def test_result_cap_timeout_metrics(spark, sf):
    m = session.Metrics()
    assert len(session.collect(spark.range(10).repartition(2), max_rows=10, metrics=m)) == 10
    assert m.rows == 10 and m.tasks > 0 and m.stages > 0
    session.collect(read(spark, f"{sf}/region.parquet"), metrics=m)
    assert m.bytes_read > 0 and m.bytes_spilled == 0
    with pytest.raises(session.ResultTooLarge):
        session.collect(spark.range(11), max_rows=10)
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(60) or x, "long")("id"))
    began = time.time()
    with pytest.raises(session.QueryTimeout):
        session.collect(slow, timeout_ms=1500)
    assert time.time() - began < 40
    assert len(session.collect(spark.range(3), timeout_ms=60_000)) == 3


@pytest.mark.parametrize("mode", ["simple", "extended", "codegen", "cost", "formatted"])
def test_explain(spark, mode):
    assert "Range" in session.explained(spark.range(3).where("id > 1"), mode) or mode == "codegen"


def test_show(spark):
    text = session.shown(spark.createDataFrame([("a" * 30, 1), ("b", 22)], "s string, n int"), 1)
    assert "aaaaaaaaaaaaaaaaa..." in text and "only showing top 1 row" in text


def test_pushdown_and_pruning(spark, sf):
    plan = session.explained(read(spark, f"{sf}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey"), "formatted")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_join_names_and_union_types(spark):
    assert {join_type(x) for x in ("LEFT_OUTER", "left outer", "leftouter", "left")} == {"left"}
    with pytest.raises(ValueError):
        join_type("sideways")
    with pytest.raises(ValueError):
        strict_union(spark.range(1), spark.range(1).select(F.col("id").cast("int")))
    with pytest.raises(ValueError):
        strict_union(spark.range(1), spark.range(1).select("id", "id"))
    assert join(spark.range(2), spark.range(3).withColumnRenamed("id", "b")).count() == 6
    assert exchange(spark.range(9), 3).rdd.getNumPartitions() == 3
    assert spark.range(5).where(typed(lambda r: (r.id > 1) & (r.id != 3))).count() == 2
    with pytest.raises(AnalysisException):
        spark.range(2).select(F.create_map("id", "id").alias("m")).distinct().collect()


def test_sql_and_dataframe_agree(spark):
    spark.range(10).createOrReplaceTempView("tidewater_t")
    a, b = spark.sql("SELECT id AS x FROM tidewater_t WHERE id > 3"), spark.table("tidewater_t").where("id > 3").select(F.col("id").alias("x"))
    assert a.sameSemantics(b)


def test_options(spark, sf):
    with pytest.raises(ValueError):
        read(spark, f"{sf}/region.parquet", colour="red")
    with pytest.raises(ValueError):
        read(spark, sf, "csv")
    assert read(spark, f"{sf}/region.parquet", MERGESCHEMA="true").count() == 5
    assert time_travel("/t@v12", {})[:2] == ("/t", 12)
    assert time_travel("/t@20200102030405678", {})[2].isoformat() == "2020-01-02T03:04:05.678000+00:00"
    assert time_travel("/t@v12", {"versionAsOf": "3"})[:2] == ("/t@v12", 3)
    for bad in ({"versionAsOf": "1", "timestampAsOf": "2020-01-01"}, {"versionAsOf": "x"}):
        with pytest.raises(ValueError):
            time_travel("/t", bad)


def test_memory_modes(spark):
    write(spark.range(2), "tw_mem", "memory")
    with pytest.raises(ValueError):
        write(spark.range(2), "tw_mem", "memory")
    write(spark.range(3), "tw_mem", "memory", "IGNORE")
    assert spark.table("tw_mem").count() == 2
    write(spark.range(3), "tw_mem", "memory", "Append")
    assert MEMORY.read("tw_mem").count() == 5
    MEMORY.drop("tw_mem")
    with pytest.raises(ValueError):
        write(spark.range(1), "x", "memory", "sometimes")
    with pytest.raises(ValueError):
        write(spark.range(1), "x", "csv")


def test_arrow_in_and_out(spark):
    t = spark.range(3).toArrow()
    assert spark.createDataFrame(t).count() == 3


def test_rows_as_objects(spark):
    from dataclasses import dataclass

    from tidewater.operators.dataset import from_objects, objects, schema_of

    @dataclass
    class Inner:
        x: int

    @dataclass
    class Outer:
        id: int
        name: str | None
        tags: list[str]
        inner: Inner | None

    globals()["Inner"], globals()["Outer"] = Inner, Outer
    rows = [Outer(1, None, ["a"], Inner(3)), Outer(2, "b", [], None)]
    df = from_objects(spark, Outer, rows)
    assert df.schema == schema_of(Outer) and not df.schema["id"].nullable and df.schema["name"].nullable
    assert sorted(objects(df, Outer), key=lambda o: o.id) == rows
    assert [o.id for o in objects(df.where(typed(lambda r: r.id > 1)), Outer)] == [2]
    with pytest.raises(ValueError):
        list(objects(df.select(F.lit(None).cast("long").alias("id"), "name", "tags", "inner"), Outer))
