import decimal
import json
import os
import random
import threading
import time
import tracemalloc
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.delta import CommitConflict, ConstraintViolation, DeltaError, DeltaTable, SchemaMismatch, UnsupportedProtocol
from tidewater.delta import dv, files, schema as sch
from tidewater.delta.log import BLIND, WHOLE, Scope, Snapshot, Transaction, conflict
from tidewater.delta.table import packed_places
from tidewater.sources import read, write
from tidewater.streaming import write_stream

DV = {"delta.enableDeletionVectors": "true"}
FEED = DV | {"delta.enableChangeDataFeed": "true"}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, name string")


def ids(df):
    return sorted((r[0] for r in df.select("id").collect()), key=str)


# --- deletion vectors -----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(65_000, 66_000), st.integers(2**32 - 5, 2**32 + 5), st.integers(0, 2**40))))
def test_vector_round_trip(rows):
    assert dv.decode(dv.encode(np.array(sorted(rows), np.uint64))).tolist() == sorted(rows)


def test_vector_bytes():
    assert dv.encode(np.array([0])).hex(" ") == "d1 d3 39 64 01 00 00 00 00 00 00 00 00 00 00 00 3a 30 00 00 01 00 00 00 00 00 00 00 10 00 00 00 00 00"
    dense = np.arange(0, 200_000, 2)
    assert (dv.decode(dv.encode(dense)) == dense).all()


def test_vector_runs_and_damage():
    import struct

    runs = struct.pack("<IQI", dv.MAGIC, 1, 0) + struct.pack("<I", dv.COOKIE_RUNS) + b"\x01" + struct.pack("<HH", 0, 9) + struct.pack("<H", 2) + struct.pack("<HHHH", 3, 4, 100, 4)
    assert dv.decode(runs).tolist() == [*range(3, 8), *range(100, 105)]
    whole = dv.encode(np.array([1, 5]))
    for bad in (whole[:-1], b"\0" + whole[1:], whole[:4] + b"\x02" + whole[5:]):
        with pytest.raises(DeltaError):
            dv.decode(bad)
    with pytest.raises(DeltaError):
        dv.unblock(dv.block(whole)[:-1] + b"\0", len(whole))


def test_vectors_stay_packed_in_memory():
    """Places merged into a vector, read back and looked up, in far less than the 8 bytes a row that numbers take."""
    n, found = 2_000_000, dv.Vector()
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * 10_000), pa.array(np.arange(i, i + 10_000))], names=["file", "row"]) for i in range(0, n, 10_000)]
    tracemalloc.start()
    for b in packed_places(iter(batches)):
        for _, key, k, body in zip(*b.columns, strict=True):
            found.add(key.as_py(), dv.unpacked(body.as_py(), k.as_py()))
    payload = found.payload()
    read = dv.vector_of({"storageType": "u", "pathOrInlineDv": dv.z85(b"0" * 16), "sizeInBytes": len(payload), "cardinality": n}, lambda *_: dv.block(payload))
    assert all(read.has(b.column(1).to_numpy()).all() for b in batches) and not read.has(np.array([n, n + 2**33])).any()
    assert tracemalloc.get_traced_memory()[1] < 4 * n
    tracemalloc.stop()
    assert len(read) == n and read.highest() == n - 1 and dv.Vector().highest() == -1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.integers(0, 9), st.integers(65_530, 65_540), st.integers(0, 2**40))), max_size=8), max_size=4))
def test_places_in_any_order_are_packed(batches):
    got = {"a": dv.Vector(), "b": dv.Vector()}
    for b in packed_places(pa.RecordBatch.from_arrays([pa.array([f for f, _ in x], pa.string()), pa.array([r for _, r in x], pa.int64())], names=["file", "row"]) for x in batches):
        for file, key, n, body in zip(*b.columns, strict=True):
            got[file.as_py()].add(key.as_py(), dv.unpacked(body.as_py(), n.as_py()))
    for file, v in got.items():
        assert dv.decode(v.payload()).tolist() == sorted({r for x in batches for f, r in x if f == file})


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40))
def test_z85(data):
    data += b"\0" * (-len(data) % 4)
    assert dv.from_z85(dv.z85(data)) == data


def test_inline_vector_is_read(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=people(spark, *[(i, "x") for i in range(10)]).coalesce(1))
    s = t.snapshot()
    a = s.adds[0]
    from tidewater.delta.log import Transaction
    from tidewater.delta.table import removal

    Transaction(t.log, s).commit([{"remove": removal(a)}, {"add": a | {"deletionVector": dv.inline(np.array([2, 7]))}}], "TEST", WHOLE)
    assert ids(t.read()) == [0, 1, 3, 4, 5, 6, 8, 9]


# --- writing and reading --------------------------------------------------------------------------------------------


def test_modes_and_versions(spark, path):
    write(people(spark, (1, "a")), path, "delta")
    with pytest.raises(ValueError):
        write(people(spark, (2, "b")), path, "delta")
    write(people(spark, (2, "b")), path, "delta", "append")
    pinned = read(spark, path, "delta")
    write(people(spark, (3, "c")), path, "delta", "overwrite")
    assert ids(pinned) == [1, 2] and ids(read(spark, path, "delta")) == [3]
    assert [ids(read(spark, path, "delta", versionAsOf=v)) for v in range(3)] == [[1], [1, 2], [3]]
    for bad in ({"versionAsOf": 9}, {"timestampAsOf": "1999-01-01"}, {"timestampAsOf": "2999-01-01"}):
        with pytest.raises(DeltaError):
            read(spark, path, "delta", **bad)


def test_timestamps_are_made_increasing(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema)
    for i in range(3):
        t.append(people(spark, (i, "x")))
    for v, ms in enumerate((5000, 4000, 4000, 9000)):
        t.store.touch(f"_delta_log/{v:020d}.json", ms)
    assert t.log.times() == {0: 5000, 1: 5001, 2: 5002, 3: 9000}
    assert t.log.version_at(datetime.fromtimestamp(5.0015, timezone.utc)) == 1


def test_partitions(spark, path):
    rows = spark.createDataFrame([(1, "eu"), (2, None), (3, "a b/=%"), (4, "")], "id long, region string")
    write(rows, path, "delta", partition_by=["region"])
    t = DeltaTable(spark, path)
    assert sorted(map(tuple, t.read().collect()), key=str) == [(1, "eu"), (2, None), (3, "a b/=%"), (4, None)]
    assert [a["partitionValues"] for a in t.skipped(t.snapshot(), "region = 'eu'")] == [{"region": "eu"}]
    assert len(t.skipped(t.snapshot(), "region IS NULL")) == 2 or len(t.skipped(t.snapshot(), "region IS NULL")) == 1
    with pytest.raises(ValueError):
        write(rows, path, "delta", "append", partition_by=["id"])
    with pytest.raises(DeltaError):
        DeltaTable.create(spark, path + "2", rows.schema, ["nowhere"])


def test_many_partitions_are_one_scan(spark, path):
    rows = spark.range(0, 400).selectExpr("id", "id % 80 AS k").repartition(1)
    write(rows, path, "delta", partition_by=["k"])
    t = DeltaTable(spark, path)
    assert sorted(map(tuple, t.read().collect())) == [(i, i % 80) for i in range(400)]


def test_schema_is_enforced(spark, path):
    t = DeltaTable.create(spark, path, T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType())]), rows=people(spark, (1, "a")))
    for bad in (people(spark, (1, "a")).withColumn("more", F.lit(1)), people(spark, (1, "a")).withColumn("name", F.lit(1)), people(spark, (1, "a")).drop("id")):
        with pytest.raises(SchemaMismatch):
            t.append(bad)
    with pytest.raises(ConstraintViolation):
        t.append(people(spark, (None, "a")))
    t.append(spark.createDataFrame([("b", 2)], "NAME string, ID int"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        write(people(spark), path, "delta", "overwrite", mergeSchema=True)


def test_nested_evolution(spark, path):
    t = DeltaTable.create(spark, path, spark.createDataFrame([], "id long, s struct<a:int>, l array<struct<x:int>>").schema)
    t.append(spark.createDataFrame([(1, (1,), [(1,)])], "id long, s struct<a:int>, l array<struct<x:int>>"))
    t.append(spark.createDataFrame([(2, (2, "b"), [(3, 4)])], "id long, s struct<a:int,b:string>, l array<struct<x:int,y:int>>"), merge_schema=True)
    got = sorted((r.id, r.s.a, r.s.b, r.l[0].y) for r in t.read().collect())
    assert got == [(1, 1, None, None), (2, 2, "b", 4)]


@pytest.mark.parametrize("old,new", [("byte", "short"), ("short", "int"), ("int", "long"), ("float", "double"), ("int", "double"), ("decimal(5,2)", "decimal(9,3)"), ("int", "decimal(10,0)"), ("date", "timestamp_ntz")])
def test_widening(spark, path, old, new):
    value = F.lit("2020-01-02").cast("date") if old == "date" else F.lit(7).cast(old)
    t = DeltaTable.create(spark, path, spark.range(0).select(value.alias("v")).schema, rows=spark.range(1).select(value.alias("v")))
    wide = spark.range(1).select(value.cast(new).alias("v"))
    with pytest.raises(SchemaMismatch):
        t.append(wide, merge_schema=True)
    t.set_properties({"delta.enableTypeWidening": "true"})
    t.append(wide, merge_schema=True)
    assert t.read().schema["v"].dataType == wide.schema["v"].dataType and len({r.v for r in t.read().collect()}) == 1
    assert t.snapshot().schema["v"].metadata["delta.typeChanges"] and t.snapshot().has_feature("typeWidening")


def test_narrowing_is_no_widening():
    assert not sch.widens(T.LongType(), T.DoubleType()) and not sch.widens(T.LongType(), T.IntegerType()) and not sch.widens(T.IntegerType(), T.DecimalType(9, 0)) and not sch.widens(T.StringType(), T.IntegerType())


def test_constraints(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, rows=people(spark, (1, "a")))
    with pytest.raises(DeltaError):
        t.set_properties({"delta.constraints.big": "id > 1"})
    t.set_properties({"delta.constraints.pos": "id > 0"})
    assert t.snapshot().has_feature("checkConstraints")
    for bad in ((0, "z"), (None, "z")):
        with pytest.raises(ConstraintViolation):
            t.append(people(spark, (2, "b"), bad))
    assert ids(t.read()) == [1]
    s = T.StructType([T.StructField("s", T.StructType([T.StructField("f", T.IntegerType(), True, {"delta.invariants": '{"expression":{"expression":"s.f > 0"}}'})]))])
    u = DeltaTable.create(spark, path + "u", s)
    with pytest.raises(ConstraintViolation):
        u.append(spark.createDataFrame([(None,)], "s struct<f:int>"))
    u.append(spark.createDataFrame([((1,),)], "s struct<f:int>"))


def test_rename_drop_and_their_guards(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties={"delta.constraints.c": "id > 0"}, rows=people(spark, (1, "a")))
    with pytest.raises(DeltaError):
        t.rename_column("name", "n")
    t.set_properties({"delta.columnMapping.mode": "name"})
    with pytest.raises(DeltaError):
        t.drop_column("id")
    t.rename_column("name", "n")
    t.append(spark.createDataFrame([(2, "b")], "id long, n string"))
    assert sorted(map(tuple, t.read().select("id", "n").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(DeltaError):
        t.rename_column("n", "id")
    t.drop_column("n")
    assert t.read().columns == ["id"]


# --- commits --------------------------------------------------------------------------------------------------------

ADD, REMOVE = {"add": {"path": "a", "dataChange": True}}, {"remove": {"path": "a", "dataChange": True}}
META = {"metaData": {}}


@pytest.mark.parametrize(
    "ours,scope,theirs,clash",
    [
        ([{"add": {"path": "n"}}], BLIND, [ADD], False),
        ([{"add": {"path": "n"}}], BLIND, [REMOVE], False),
        ([{"add": {"path": "n"}}], BLIND, [META], True),
        ([{"add": {"path": "n"}}], BLIND, [{"protocol": {}}], True),
        ([{"add": {"path": "n"}}], WHOLE, [ADD], True),
        ([{"add": {"path": "n"}}], WHOLE, [REMOVE], True),
        ([{"add": {"path": "n"}}], WHOLE, [{"txn": {"appId": "x", "version": 1}}], False),
        ([{"remove": {"path": "b"}}], Scope(frozenset({"b"})), [ADD], False),
        ([{"remove": {"path": "a"}}], Scope(frozenset({"a"})), [REMOVE], True),
        ([{"remove": {"path": "a"}}], Scope(frozenset({"a"})), [REMOVE, {"add": {"path": "a", "deletionVector": {}}}], True),
        ([{"txn": {"appId": "x", "version": 2}}], BLIND, [{"txn": {"appId": "x", "version": 1}}], True),
        ([META], WHOLE, [ADD], True),
    ],
)
def test_conflicts(ours, scope, theirs, clash):
    assert bool(conflict(ours, scope, theirs)) == clash


def test_losing_a_race(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=people(spark, *[(i, "x") for i in range(10)]).coalesce(1))
    raced = []

    def rival(do):
        def before(version):
            if not raced:
                raced.append(version)
                do()

        return before

    assert t.append(people(spark, (20, "y")), before=rival(lambda: t.append(people(spark, (21, "z"))))) == 2
    raced.clear()
    with pytest.raises(CommitConflict):
        t.overwrite(people(spark, (1, "x")), before=rival(lambda: t.append(people(spark, (22, "z")))))
    raced.clear()
    with pytest.raises(CommitConflict):
        t.delete("id = 3", before=rival(lambda: t.delete("id = 4")))
    assert ids(t.read()) == sorted([0, 1, 2, 3, 5, 6, 7, 8, 9, 20, 21, 22], key=str)


def test_put_if_absent_has_one_winner(spark, path):
    store = DeltaTable(spark, path).store
    won = []
    threads = [threading.Thread(target=lambda i=i: store.put_if_absent("_delta_log/x", str(i).encode()) and won.append(i)) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.read("_delta_log/x") == str(won[0]).encode()


def test_protocols(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema)
    for bad in ({"minReaderVersion": 2, "minWriterVersion": 5}, {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["v2Checkpoint"], "writerFeatures": []}):
        with open(f"{path[7:]}/_delta_log/{1:020d}.json", "w") as f:
            f.write(json.dumps({"protocol": bad}))
        with pytest.raises(UnsupportedProtocol):
            t.read()
    with open(f"{path[7:]}/_delta_log/{1:020d}.json", "w") as f:
        f.write(json.dumps({"protocol": {"minReaderVersion": 1, "minWriterVersion": 7, "writerFeatures": ["generatedColumns"]}}))
    assert t.read().count() == 0
    with pytest.raises(UnsupportedProtocol):
        t.append(people(spark, (1, "a")))


def test_damaged_logs(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, rows=people(spark, (1, "a")))
    t.append(people(spark, (2, "b")))
    t.log.checkpoint()
    t.append(people(spark, (3, "c")))
    with open(f"{path[7:]}/_delta_log/{1:020d}.checkpoint.parquet", "wb") as f:
        f.write(b"not parquet")
    crc = f"{path[7:]}/_delta_log/.{1:020d}.checkpoint.parquet.crc"
    if os.path.exists(crc):
        os.unlink(crc)
    assert ids(t.read()) == [1, 2, 3]
    os.unlink(f"{path[7:]}/_delta_log/{1:020d}.json")
    with pytest.raises(DeltaError):
        t.read()
    with pytest.raises(DeltaError):
        DeltaTable(spark, path + "nowhere").read()


# --- maintenance ----------------------------------------------------------------------------------------------------


def test_model_replay(spark, path):
    """Random writes against a plain list, and the change feed against the difference of versions."""
    rng = random.Random(11)
    t = DeltaTable.create(spark, path, people(spark).schema, properties=FEED)
    model, history = [], [[]]
    for step in range(8):
        kind = rng.choice(["append", "append", "delete", "overwrite", "optimize"])
        new = [(rng.randint(0, 20), f"s{step}") for _ in range(rng.randint(1, 6))]
        if kind == "append":
            t.append(people(spark, *new))
            model += new
        elif kind == "overwrite":
            t.overwrite(people(spark, *new))
            model = new
        elif kind == "delete":
            if t.delete("id % 3 = 0"):
                model = [r for r in model if r[0] % 3]
            else:
                continue
        elif t.optimize().version is None:
            continue
        history.append(list(model))
        assert sorted(map(tuple, t.read().collect())) == sorted(model)
    assert t.log.latest() == len(history) - 1
    for v, rows in enumerate(history):
        assert sorted(map(tuple, t.read(version=v).collect())) == sorted(rows)
    from collections import Counter

    for v in range(1, len(history)):
        now = Counter()
        for r in t.changes(v, v).collect():
            now[(r.id, r.name)] += 1 if r._change_type == "insert" else -1
        assert {k: n for k, n in now.items() if n} == {k: n for k in {*history[v], *history[v - 1]} if (n := history[v].count(k) - history[v - 1].count(k))}


def test_delete(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=people(spark, *[(i, None if i % 4 == 0 else f"n{i}") for i in range(100)]).repartition(3))
    files = sorted(os.listdir(path[7:]))
    assert t.delete("name = 'n5' OR id > 90") == 10
    assert t.delete("name = 'none'") == 0
    assert t.delete("name IS NULL") == 23
    assert t.read().count() == 67 and t.statistics()["numRecords"] == 67
    assert set(files) <= set(os.listdir(path[7:]))
    assert t.delete("true") == 67 and t.snapshot().adds == []
    plain = DeltaTable.create(spark, path + "p", people(spark).schema)
    with pytest.raises(DeltaError):
        plain.delete("true")


def test_delete_under_mapping_with_feed(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=FEED | {"delta.columnMapping.mode": "name"}, rows=people(spark, (1, "a"), (2, "b")))
    t.rename_column("name", "label")
    t.delete("label = 'a'")
    assert [(r.id, r.label, r._change_type, r._commit_version) for r in t.changes(2, 2).collect()] == [(1, "a", "delete", 2)]
    with pytest.raises(DeltaError):
        DeltaTable.create(spark, path + "q", people(spark).schema).changes(0)


def test_vacuum_and_optimize(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=people(spark, *[(i, "x") for i in range(40)]).repartition(4))
    t.delete("id = 3")
    dry = t.optimize(dry_run=True)
    assert dry.version is None and len(dry.removed) == 3
    done = t.optimize()
    assert done.added == 1 and t.read().count() == 39
    assert not any(a.get("dataChange") for x in t.log.actions(done.version) for a in x.values() if "path" in a)
    with pytest.raises(DeltaError):
        t.vacuum(timedelta(hours=1))
    with pytest.raises(DeltaError):
        t.vacuum(timedelta(hours=-1), unsafe=True)
    assert t.vacuum().removed == []
    later = time.time() + 100
    dry = t.vacuum(timedelta(0), dry_run=True, unsafe=True, now=later)
    assert len(dry.removed) == 3 and t.read().count() == 39
    assert sorted(t.vacuum(timedelta(0), unsafe=True, now=later).removed) == sorted(dry.removed)
    assert t.read().count() == 39
    with pytest.raises(DeltaError):
        t.optimize("id = 1")


def test_skipping_never_loses_rows(spark, path):
    rng = random.Random(2)
    rows = [(rng.choice([None, rng.randint(-50, 50)]), rng.choice([None, "", "a" * 40, "a" * 40 + "z", "é", "z"])) for _ in range(200)]
    t = DeltaTable.create(spark, path, people(spark).schema, rows=people(spark, *rows).repartitionByRange(6, "id"))
    for where in ("id > 20", "5 >= id", "id = 7", "id IS NULL", "id IS NOT NULL AND id < 1.5", "name = 'z'", f"name > '{'a' * 40}'", "name < 'b' AND id < 0", "id = 7 OR name = 'z'", "id + 1 = 3"):
        assert t.read(where=where).count() == t.read().where(where).count(), where
    assert len(t.skipped(t.snapshot(), "id > 49")) <= 2


def test_stream(spark, path, tmp_path):
    src = str(tmp_path / "src")
    people(spark, (1, "a"), (2, "b")).write.parquet(src)
    t = DeltaTable.create(spark, path, people(spark).schema)
    for _ in range(2):
        q = write_stream(spark.readStream.schema("id long, name string").parquet(src), path, str(tmp_path / "cp"), "job")
        q.awaitTermination(60)
        people(spark, (3, "c")).write.mode("append").parquet(src)
    assert ids(t.read()) == [1, 2, 3]
    assert t.append(people(spark, (9, "z")), txn=("job", 0)) is None


def snapshot_of(name, partitioned=False):
    return Snapshot(metadata={"schemaString": json.dumps({"type": "struct", "fields": [{"name": "c", "type": name, "nullable": True, "metadata": {}}]}), "partitionColumns": ["c"] if partitioned else []})


OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(10**19), 10**19), min_size=1, max_size=4), st.integers(-3, 3), st.sampled_from(sorted(OPS)), st.sampled_from(["decimal", "long", "double literal"]))
def test_exact_bounds_lose_no_row(units, off, op, kind):
    """Values with more digits than a double has, against a literal that is nearly one of them."""
    if kind == "decimal":
        values, v = [decimal.Decimal(x).scaleb(-2) for x in units], decimal.Decimal(units[0] + off).scaleb(-2)
    else:
        values = [max(min(x, 2**63 - 1), -(2**63)) for x in units]
        v = float(values[0] + off) if kind == "double literal" else decimal.Decimal(values[0] + off)
    add = {"path": "f", "stats": files.statistics_json({"numRecords": len(values), "minValues": {"c": min(values)}, "maxValues": {"c": max(values)}, "nullCount": {"c": 0}})}
    seen = [float(x) for x in values] if kind == "double literal" else values
    matches = any(OPS[op](x, v) for x in seen)
    assert files.may_match(snapshot_of("decimal(21,2)" if kind == "decimal" else "long"), add, [("c", op, v)]) or not matches


def test_bounds_keep_their_digits(spark, path):
    rows = spark.createDataFrame([(decimal.Decimal(2**60 + 1), 9007199254740993)], "c decimal(20,0), n long")
    t = DeltaTable.create(spark, path, rows.schema, properties=DV, rows=rows)
    assert '"c":1152921504606846977' in t.snapshot().adds[0]["stats"].replace(" ", "")
    assert t.read(where=f"c > {2**60}").count() == 1 and t.read(where="n = 9007199254740993.0").count() == 1
    assert t.read(where=f"c > {2**60 + 1}").count() == 0 and t.skipped(t.snapshot(), "n > 9007199254740993.0") == []
    assert t.delete(f"c > {2**60}") == 1 and t.read().count() == 0


@pytest.mark.parametrize("kind", ["double", "float"])
def test_partitions_of_unusual_numbers(spark, path, kind):
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(["nan", "inf", "-inf", "1.5", "0.1", "-0.0", "1e300" if kind == "double" else "1e30"])] + [(9, None)], f"id long, p {kind}")
    t = DeltaTable.create(spark, path, rows.schema, ["p"], DV, rows=rows)
    for where in ("p > 2", "p >= 1.5", "p = 1.5", "p < 0.5", "p <= 0", "p = 0.1", "p > 0.1D", "p IS NULL", "p = 1e300D"):
        assert ids(t.read(where=where)) == ids(rows.where(where)), where
    assert t.delete("p > 2") == 3 and ids(t.read()) == [2, 3, 4, 5, 9]


def test_deleted_rows_are_masked_where_they_are_read(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=people(spark, *[(i, f"n{i}") for i in range(200)]).repartition(3))
    assert t.delete("id % 5 = 0") == 40 and t.delete("id % 5 = 1") == 40
    df = t.read().where("id < 150")
    assert sorted(ids(df)) == [i for i in range(150) if i % 5 > 1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_optimize_shuffles_nothing_and_vacuum_deletes_all(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, rows=people(spark, *[(i, "n") for i in range(60)]).repartition(12))
    report = t.optimize()
    assert report.added == 1 and t.statistics()["numFiles"] == 1 and sorted(ids(t.read())) == list(range(60))
    gone = t.vacuum(timedelta(0), unsafe=True, now=time.time() + 10)
    assert sorted(gone.removed) == sorted(report.removed) and not any(t.store.exists(p) for p in gone.removed) and t.read().count() == 60


def stages_of(spark, group):
    """What Spark's books have on the stages of a job group."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    return [sc._jsc.sc().statusStore().lastStageAttempt(i) for j in jobs for i in j.stageIds]


def test_optimize_has_a_task_for_each_bin_and_sorts_nothing(spark, path):
    rows = spark.range(0, 600).selectExpr("id", "nullif(concat('a/b=', id % 3), 'a/b=2') AS k").repartition(4)
    t = DeltaTable.create(spark, path, rows.schema, ["k"], rows=rows)
    before = sorted(map(tuple, t.read().collect()), key=str)
    spark.sparkContext.setJobGroup("bins", "")
    report = t.optimize()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = stages_of(spark, "bins")
    assert sum(s.numTasks() for s in stages if s.outputRecords()) == report.added == t.statistics()["numFiles"] == 3
    assert all(s.peakExecutionMemory() == 0 for s in stages)
    assert sorted(map(tuple, t.read().collect()), key=str) == before and ids(t.read(where="k = 'a/b=1'")) == sorted(range(1, 600, 3), key=str)
    assert {a["partitionValues"]["k"] for a in t.snapshot().adds} == {"a/b=0", "a/b=1", None}


def test_delete_shuffles_containers(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties=DV, rows=spark.range(0, 200_000).selectExpr("id", "'n' AS name").coalesce(2))
    files_of = t.statistics()["numFiles"]
    for where, n in (("id % 3 = 0", 66_667), ("id % 3 = 1", 66_667), ("id >= 100000", 33_333)):
        spark.sparkContext.setJobGroup(where, "")
        assert t.delete(where) == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < sum(s.shuffleWriteRecords() for s in stages_of(spark, where)) <= 4 * files_of
    assert t.read().selectExpr("count(*)", "sum(id)").collect()[0][:] == (33_333, sum(range(2, 100_000, 3)))


def test_checkpoints_forget_old_removals_and_are_hinted(spark, path):
    t = DeltaTable.create(spark, path, people(spark).schema, properties={"delta.deletedFileRetentionDuration": "interval 0 days"}, rows=people(spark, (1, "a")))
    t.overwrite(people(spark, (2, "b")))
    time.sleep(0.01)
    t.log.checkpoint()
    assert t.log._hinted() == 1
    t.store.delete(f"_delta_log/{0:020d}.json")
    t.store.delete(f"_delta_log/{1:020d}.json")
    s = t.snapshot()
    assert not s.removed and ids(t.read()) == [2]


def test_update_images_in_the_feed(spark, path):
    """Change files of another writer that hold the rows before and after an update."""
    t = DeltaTable.create(spark, path, people(spark).schema, properties=FEED, rows=people(spark, (1, "a"), (2, "b")))
    kinds = spark.createDataFrame([(1, "a", "update_preimage"), (1, "z", "update_postimage")], "id long, name string, _change_type string")
    kept = T.StructType([*t.snapshot().schema.fields, T.StructField("_change_type", T.StringType())])
    cdc = files.stage(spark, t.store, kinds, kept, [], "none", False, "_change_data/w")
    adds = files.stage(spark, t.store, people(spark, (1, "z"), (2, "b")), t.snapshot().schema, [], "none")
    old = t.snapshot().adds
    actions = [*({"remove": {"path": a["path"], "dataChange": True}} for a in old), *({"add": a} for a in adds), *({"cdc": {k: a[k] for k in ("path", "partitionValues", "size", "dataChange")}} for a in cdc)]
    Transaction(t.log, t.snapshot()).commit(actions, "UPDATE", WHOLE)
    assert sorted((r.id, r.name, r._change_type) for r in t.changes(1).collect()) == [(1, "a", "update_preimage"), (1, "z", "update_postimage")]
    assert sorted(map(tuple, t.read().collect())) == [(1, "z"), (2, "b")]
