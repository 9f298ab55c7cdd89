"""Queries over tables of the log format: each writes a table, changes it and returns what it then holds."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..delta import ConstraintViolation, DeltaError, DeltaTable
from ..sources import MEMORY, read, write
from .catalog import query, table

ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"
FULL_FEED = {"delta.enableDeletionVectors": "true", "delta.enableChangeDataFeed": "true"}


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return f"{named.rstrip('/')}/table-{uuid.uuid4().hex}"


def orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def made(spark, df: DataFrame, partition_by: list[str] = (), properties: dict[str, str] | None = None) -> DeltaTable:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return DeltaTable.create(spark, scratch(spark), schema, list(partition_by), properties, rows=df)


@query(f"SELECT * FROM {ORDERS}")
def delta_append(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows.where("o_orderkey % 3 = 0"), path, "delta")
    write(rows.where("o_orderkey % 3 <> 0"), path, "delta", "append")
    return read(spark, path, "delta")


@query(f"SELECT * FROM {ORDERS} WHERE o_orderstatus = 'F'")
def delta_overwrite(spark, sf):
    """The table is overwritten with rows read from it."""
    path = scratch(spark)
    write(orders(spark, sf), path, "delta")
    write(read(spark, path, "delta").where("o_orderstatus = 'F'"), path, "delta", "overwrite")
    return read(spark, path, "delta")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM {ORDERS} WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0")
def delta_dynamic_overwrite(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows, path, "delta", partition_by=["o_orderstatus"])
    write(rows.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)), path, "delta", "overwrite", partitionOverwriteMode="dynamic")
    return read(spark, path, "delta").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT r_regionkey, r_name, true AS refused FROM region")
def delta_ignore(spark, sf):
    """Ignore leaves a table as it is; errorifexists refuses."""
    path, rows = scratch(spark), table(spark, sf, "region")
    write(rows, path, "delta")
    write(rows.limit(1), path, "delta", "ignore")
    try:
        write(rows, path, "delta")
        refused = False
    except ValueError:
        refused = True
    return read(spark, path, "delta").withColumn("refused", F.lit(refused))


@query(f"SELECT * FROM {ORDERS} WHERE o_orderkey % 2 = 0")
def delta_version_as_of(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows.where("o_orderkey % 2 = 0"), path, "delta")
    write(rows.where("o_orderkey % 2 = 1"), path, "delta", "append")
    return read(spark, path, "delta", versionAsOf=0)


@query(f"SELECT * FROM {ORDERS} WHERE o_orderkey % 2 = 0")
def delta_version_suffix(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows.where("o_orderkey % 2 = 0"), path, "delta")
    write(rows, path, "delta", "overwrite")
    return read(spark, f"{path}@v0", "delta")


@query(f"SELECT * FROM {ORDERS} WHERE o_orderkey % 2 = 0")
def delta_timestamp_as_of(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows.where("o_orderkey % 2 = 0"), path, "delta")
    write(rows.where("o_orderkey % 2 = 1"), path, "delta", "append")
    t = DeltaTable(spark, path)
    for v, ms in ((0, 1_600_000_000_000), (1, 1_600_000_100_000)):
        t.store.touch(f"_delta_log/{v:020d}.json", ms)
    return read(spark, path, "delta", timestampAsOf="2020-09-13T12:27:30")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey END AS region FROM nation WHERE n_regionkey < 2")
def delta_merge_schema(spark, sf):
    path, rows = scratch(spark), table(spark, sf, "nation")
    write(rows.where("n_regionkey = 0").select("n_nationkey", "n_name"), path, "delta")
    write(rows.where("n_regionkey = 1").select("n_name", "n_nationkey", F.col("n_regionkey").alias("region")), path, "delta", "append", mergeSchema=True)
    return read(spark, path, "delta")


@query("SELECT r_name AS name, r_regionkey * 10 AS tenfold FROM region")
def delta_overwrite_schema(spark, sf):
    path = scratch(spark)
    write(table(spark, sf, "nation"), path, "delta")
    write(table(spark, sf, "region").selectExpr("r_name AS name", "r_regionkey * 10 AS tenfold"), path, "delta", "overwrite", overwriteSchema=True)
    return read(spark, path, "delta")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus = 'F'")
def delta_partitioned(spark, sf):
    path = scratch(spark)
    write(table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")), path, "delta", partition_by=["status"])
    return read(spark, path, "delta").where("status IS NULL OR status = 'F'")


@query("SELECT CAST(p_size AS BIGINT) + 4294967296 * big AS n, CAST(x AS DOUBLE) AS x FROM (SELECT p_size, 0 AS big, p_size / 2 AS x FROM part UNION ALL SELECT p_size, 1, p_size / 4 FROM part)")
def delta_type_widening(spark, sf):
    t = made(spark, table(spark, sf, "part").select(F.col("p_size").alias("n"), (F.col("p_size") / 2).cast("float").alias("x")), properties={"delta.enableTypeWidening": "true"})
    t.append(table(spark, sf, "part").select((F.col("p_size") + F.lit(4294967296)).alias("n"), (F.col("p_size") / 4).alias("x")), merge_schema=True)
    return t.read()


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS key FROM nation")
def delta_column_mapping(spark, sf):
    s = F.when(F.col("n_regionkey") != 2, F.struct(F.col("n_regionkey").alias("key"))).alias("s")
    t = made(spark, table(spark, sf, "nation").select("n_nationkey", "n_name", s), properties={"delta.columnMapping.mode": "id"})
    return t.read().select("n_nationkey", "n_name", F.col("s.key").alias("key"))


@query("SELECT n_nationkey AS id, n_regionkey AS inner FROM nation UNION ALL SELECT 100, 7")
def delta_rename_drop(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", F.struct("n_regionkey", F.lit(1).alias("gone")).alias("s"))
    t = made(spark, rows, properties={"delta.columnMapping.mode": "name"})
    t.rename_column("n_nationkey", "id")
    t.rename_column("s.n_regionkey", "inner")
    t.drop_column("s.gone")
    t.drop_column("n_name")
    t.append(spark.createDataFrame([(100, (7,))], "id int, s struct<inner:int>"))
    return t.read().select("id", "s.inner")


@query("SELECT c_custkey, c_acctbal, 3 AS refused FROM customer WHERE c_acctbal > 0")
def delta_constraint(spark, sf):
    """A CHECK constraint refuses rows for which it is false or null, and an invariant does too; nothing of such a write stays."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    schema = T.StructType([T.StructField("c_custkey", T.LongType(), True, {"delta.invariants": '{"expression": {"expression": "c_custkey >= 0"}}'}), T.StructField("c_acctbal", T.DoubleType())])
    t = DeltaTable.create(spark, scratch(spark), schema, properties={"delta.constraints.positive": "c_acctbal > 0"})
    t.append(rows.where("c_acctbal > 0"))
    refused = 0
    for bad in (rows, rows.where("c_acctbal > 0").limit(1).withColumn("c_acctbal", F.lit(None).cast("double")), rows.where("c_acctbal > 0").limit(1).withColumn("c_custkey", F.lit(-1).cast("long"))):
        try:
            t.append(bad)
        except ConstraintViolation:
            refused += 1
    return t.read().withColumn("refused", F.lit(refused))


@query("SELECT r_regionkey, r_name, 'deleted rows: refused' AS said FROM region")
def delta_append_only(spark, sf):
    t = made(spark, table(spark, sf, "region"), properties={"delta.appendOnly": "true", "delta.enableDeletionVectors": "true"})
    try:
        t.delete("r_regionkey = 1")
        said = "deleted rows: allowed"
    except Exception as e:
        said = "deleted rows: refused" if "append-only" in str(e) else str(e)
    return t.read().withColumn("said", F.lit(said))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM {ORDERS} WHERE NOT coalesce(o_totalprice > 100000 OR o_orderkey % 10 = 0, false)")
def delta_delete_dv(spark, sf):
    """Two deletes, the second on files that have a deletion vector already."""
    t = made(spark, orders(spark, sf), properties={"delta.enableDeletionVectors": "true"})
    t.delete("o_totalprice > 100000")
    t.delete("o_orderkey % 10 = 0")
    return t.read()


@query("""SELECT n_nationkey, n_name, 'insert' AS change, CAST(0 AS BIGINT) AS version FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT n_nationkey, n_name, 'insert', 1 FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_name, 'delete', 2 FROM nation WHERE n_regionkey < 3 AND n_nationkey % 2 = 0""")
def delta_cdf(spark, sf):
    rows = table(spark, sf, "nation")
    t = made(spark, rows.where("n_regionkey < 2"), properties=FULL_FEED)
    t.append(rows.where("n_regionkey = 2"))
    t.delete("n_nationkey % 2 = 0")
    return t.changes(0, 2).select("n_nationkey", "n_name", F.col("_change_type").alias("change"), F.col("_commit_version").alias("version"))


@query("SELECT n_nationkey, 'insert' AS change FROM nation UNION ALL SELECT n_nationkey, 'delete' FROM nation UNION ALL SELECT n_nationkey, 'insert' FROM nation WHERE n_regionkey = 1")
def delta_cdf_overwrite(spark, sf):
    """What an overwrite's adds and removes imply."""
    rows = table(spark, sf, "nation")
    t = made(spark, rows, properties=FULL_FEED)
    t.overwrite(rows.where("n_regionkey = 1"))
    return t.changes(0).select("n_nationkey", F.col("_change_type").alias("change"))


@query(f"SELECT *, true AS fewer FROM {ORDERS}")
def delta_optimize(spark, sf):
    t = made(spark, orders(spark, sf).repartition(6), ["o_orderstatus"])
    before = t.statistics()["numFiles"]
    t.optimize()
    return t.read().withColumn("fewer", F.lit(t.statistics()["numFiles"] < before))


@query(f"SELECT *, true AS cleaned FROM {ORDERS} WHERE o_orderstatus = 'O'")
def delta_vacuum(spark, sf):
    t = made(spark, orders(spark, sf))
    old = {a["path"] for a in t.snapshot().adds}
    t.overwrite(orders(spark, sf).where("o_orderstatus = 'O'"))
    import time

    report = t.vacuum(timedelta(hours=0), unsafe=True, now=time.time() + 10)
    return t.read().withColumn("cleaned", F.lit(old == set(report.removed)))


@query(f"SELECT *, true AS skipped FROM {ORDERS} WHERE o_orderkey < 100 AND o_orderstatus = 'F'")
def delta_file_skipping(spark, sf):
    t = made(spark, orders(spark, sf).repartitionByRange(4, "o_orderkey"), ["o_orderstatus"])
    where, s = "o_orderkey < 100 AND o_orderstatus = 'F'", t.snapshot()
    return t.read(where=where).withColumn("skipped", F.lit(len(t.skipped(s, where)) < len(s.adds) / 3))


@query("""SELECT * FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) + 1152921504606846 AS price, CAST(o_orderkey AS BIGINT) + 9007199254740992 AS n FROM orders)
    WHERE price > 1152921504706846.0 AND n > 9007199254740993.0 AND NOT (price > 1152921504806846.07 OR n = 9007199254741024.0)""")
def delta_file_skipping_decimal(spark, sf):
    """Bounds and literals with more digits than a double has: files are skipped for reading, and then for DELETE."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1152921504606846 AS DECIMAL(20,2)) AS price", "CAST(o_orderkey AS BIGINT) + 9007199254740992 AS n")
    t = made(spark, rows.repartitionByRange(6, "price"), properties={"delta.enableDeletionVectors": "true"})
    t.delete("price > 1152921504806846.07")
    t.delete("n = 9007199254741024.0")
    return t.read(where="price > 1152921504706846.0 AND n > 9007199254740993.0").withColumn("price", F.col("price").cast("decimal(21,2)"))


@query(f"SELECT * FROM {ORDERS} WHERE o_orderkey % 2 = 0")
def delta_timestamp_suffix(spark, sf):
    path, rows = scratch(spark), orders(spark, sf)
    write(rows.where("o_orderkey % 2 = 0"), path, "delta")
    write(rows.where("o_orderkey % 2 = 1"), path, "delta", "append")
    t = DeltaTable(spark, path)
    for v, ms in ((0, 1_600_000_000_000), (1, 1_600_000_100_000)):
        t.store.touch(f"_delta_log/{v:020d}.json", ms)
    return read(spark, f"{path}@20200913122730", "delta")


@query("SELECT n_nationkey, n_name, 'refused' AS said FROM nation")
def delta_schema_enforced(spark, sf):
    """Rows with a column or a type that the table does not have are refused, and nothing of them stays."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    t, said = made(spark, rows), "refused"
    for bad in (rows.withColumn("more", F.lit(1)), rows.withColumn("n_nationkey", F.col("n_name"))):
        try:
            t.append(bad)
            said = "taken"
        except Exception as e:
            said = said if isinstance(e, DeltaError) else str(e)
    return t.read().withColumn("said", F.lit(said))


@query("SELECT n_nationkey, 'delete' AS change, CAST(2 AS BIGINT) AS version FROM nation WHERE n_regionkey = 1")
def delta_cdf_enabled_later(spark, sf):
    t = made(spark, table(spark, sf, "nation"), properties={"delta.enableDeletionVectors": "true"})
    t.set_properties({"delta.enableChangeDataFeed": "true"})
    t.delete("n_regionkey = 1")
    return t.changes(2).select("n_nationkey", F.col("_change_type").alias("change"), F.col("_commit_version").alias("version"))


@query("SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def delta_statistics(spark, sf):
    """Counted from the log alone."""
    s = made(spark, orders(spark, sf), ["o_orderstatus"]).statistics()
    return spark.createDataFrame([(s["numRecords"], s["columns"]["o_orderkey"]["min"], s["columns"]["o_orderkey"]["max"])], "n long, low long, high long")


@query("SELECT r_regionkey, r_name FROM region")
def delta_idempotent_txn(spark, sf):
    t = made(spark, table(spark, sf, "region").where("r_regionkey < 2"))
    for _ in range(2):
        t.append(table(spark, sf, "region").where("r_regionkey >= 2"), txn=("job", 7))
    return t.read()


@query(f"SELECT * FROM {ORDERS}")
def delta_checkpoint_read(spark, sf):
    """Read from a checkpoint and one commit after it, the earlier commits being gone."""
    rows = orders(spark, sf)
    t = made(spark, rows.where("o_orderkey % 3 = 0"))
    t.append(rows.where("o_orderkey % 3 = 1"))
    t.log.checkpoint()
    t.append(rows.where("o_orderkey % 3 = 2"))
    t.store.delete(f"_delta_log/{0:020d}.json")
    return t.read()


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 0")
def memory_sink_modes(spark, sf):
    rows, name = table(spark, sf, "region"), f"tidewater_{uuid.uuid4().hex}"
    write(rows.limit(2), name, "memory")
    write(rows, name, "memory", "overwrite")
    write(rows.where("r_regionkey = 0"), name, "memory", "append")
    write(rows, name, "memory", "ignore")
    return MEMORY.read(name)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 4")
def parquet_save_modes(spark, sf):
    path, rows = scratch(spark), table(spark, sf, "nation")
    write(rows.where("n_regionkey = 0"), path, "parquet", partition_by=["n_regionkey"])
    write(rows.where("n_regionkey IN (1, 2, 3)"), path, "parquet", "append", partition_by=["n_regionkey"])
    write(rows, path, "parquet", "ignore")
    return read(spark, path, "parquet").select("n_nationkey", "n_name", "n_regionkey")
