"""Data files: staging with statistics, scanning with partition values and deletion vectors, skipping."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dv
from .errors import DeltaError
from .log import Snapshot, now_ms
from .schema import PHYSICAL, physical, plain
from .store import Entry, Store, in_log, on_disk

#: Columns with statistics, letters of a string bound; tuples of partition values up to which each is a scan of its own.
STATS_COLUMNS, STATS_LETTERS, SCANS = 32, 32, 64
#: Bins that OPTIMIZE rewrites at a time.
BINS = 64
NULL_DIR = "__HIVE_DEFAULT_PARTITION__"


def arrow_uri(url: str) -> str:
    """A Hadoop name as a URI for pyarrow, which decodes it."""
    return quote(re.sub(r"^file:/+", "file:///", url), safe=":/@")


def mode_of(s: Snapshot) -> str:
    return s.properties.get("delta.columnMapping.mode", "none")


def physical_name(f: T.StructField, mode: str) -> str:
    return f.metadata.get(PHYSICAL, f.name) if mode != "none" else f.name


def _json_value(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat(timespec="milliseconds") + ("" if v.tzinfo is None else "Z" if v.utcoffset() == datetime.timedelta(0) else "")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def statistics_json(stats: dict) -> str:
    """As the log has them: decimals are numbers with all their digits, which a double would round."""
    mark = uuid.uuid4().hex
    return re.sub(f'"{mark}([^"]*)"', r"\1", json.dumps(stats, default=lambda v: f"{mark}{v:f}"))


def statistics_of(add: dict) -> dict:
    """An add action's statistics, numbers with a point as decimals."""
    return json.loads(add.get("stats") or "{}", parse_float=decimal.Decimal)


def footer_statistics(path: str) -> dict:
    """numRecords, minValues, maxValues and nullCount of a Parquet file, from its footer alone."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    meta = pq.read_metadata(at, filesystem=store)
    low, high, nulls = {}, {}, {}
    for i in range(meta.num_columns):
        name = meta.schema.column(i).path.split(".")
        if len({meta.schema.column(k).path.split(".")[0] for k in range(i + 1)}) > STATS_COLUMNS:
            break
        if meta.schema.column(i).max_repetition_level:
            continue
        a = b = None
        n, bounded, counted = 0, True, True
        for g in range(meta.num_row_groups):
            c = meta.row_group(g).column(i)
            s = c.statistics
            if s is None or s.null_count is None:
                counted = bounded = False
                break
            n += s.null_count
            if s.null_count == c.num_values:
                continue
            if not s.has_min_max or isinstance(s.min, bytes) or s.min != s.min or s.max != s.max:
                bounded = False
                continue
            a, b = s.min if a is None else min(a, s.min), s.max if b is None else max(b, s.max)

        def put(tree: dict, v, name=name) -> None:
            for part in name[:-1]:
                tree = tree.setdefault(part, {})
            tree[name[-1]] = v

        if counted:
            put(nulls, n)
        if bounded and a is not None:
            if isinstance(a, str):
                put(low, a[:STATS_LETTERS])
                put(high, b if len(b) <= STATS_LETTERS else b[:STATS_LETTERS] + "\U0010ffff")
            elif not isinstance(a, float) or math.isfinite(a) and math.isfinite(b):
                put(low, _json_value(a))
                put(high, _json_value(b))
    return {"numRecords": meta.num_rows, "minValues": low, "maxValues": high, "nullCount": nulls, "tightBounds": True}


def _partition_values(path: str, columns: list[str]) -> dict[str, str | None]:
    found = dict(unquote(p).split("=", 1) for p in path.split("/")[:-1] if "=" in p)
    return {c: None if found[c] == NULL_DIR else found[c] for c in columns}


def stage(spark: SparkSession, store: Store, df: DataFrame, fields: T.StructType, partitions: list[str], mode: str, change: bool = True, folder: str | None = None, extra: list[str] = ()) -> list[dict]:
    """Writes df (logical columns of `fields`, plus `extra`) into a folder of its own and returns add actions.

    Executors write; nothing is renamed, so writers do not meet and a failure leaves files that no log names. Statistics
    come from the footers, read by executors.
    """
    out = df.select(*_stored(fields, mode), *[F.col(f"`{c}`") for c in extra])
    folder = folder or f"w-{uuid.uuid4().hex}"
    named = [physical_name(fields[c], mode) for c in partitions]
    by = named + list(extra)
    writer = out.write.option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(store.url(folder))
    return _added(spark, store, folder, lambda e: _partition_values(e.path, named), change)


def restage(spark: SparkSession, store: Store, s: Snapshot, bins: list[list[dict]]) -> list[dict]:
    """Rewrites each bin, files of the same partition values, as one file; returns add actions.

    A bin is a job of one task, BINS of them at a time: a union of the bins would be one task for all, as Spark joins parts of
    one partition each into one. The values are known, so that nothing is sorted by them; a task holds what a writer holds.
    """
    partitions, mode, folder = {c.lower() for c in s.partition_columns}, mode_of(s), f"w-{uuid.uuid4().hex}"
    data = T.StructType([f for f in s.schema.fields if f.name.lower() not in partitions])
    named = store.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString

    def write(i: int, files: list[dict]) -> None:
        at = "/".join([folder, str(i), *(named(k, v) for k, v in (files[0].get("partitionValues") or {}).items())])
        scan(spark, store, s, files).select(*_stored(data, mode)).coalesce(1).write.option("compression", "snappy").parquet(store.url(at))

    with ThreadPoolExecutor(min(BINS, len(bins))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(partial(write, i, b))) for i, b in enumerate(bins)]
        try:
            for j in jobs:
                j.result()
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
    return _added(spark, store, folder, lambda e: bins[int(e.path.split("/")[1])][0].get("partitionValues") or {}, False)


def _stored(fields: T.StructType, mode: str) -> list[Column]:
    """The logical columns as files have them; the cast carries nested names and field ids."""
    return [F.col(f"`{f.name}`").cast(p.dataType).alias(p.name, metadata=p.metadata) for f, p in zip(fields.fields, physical(fields, mode).fields, strict=True)]


def _added(spark: SparkSession, store: Store, folder: str, values_of: Callable[[Entry], dict], change: bool) -> list[dict]:
    """Add actions of the files written into a folder; files without rows go."""
    found = [e for e in store.walk(folder) if e.path.endswith(".parquet")]
    stats = _statistics(spark, store, [e.path for e in found])
    modified = now_ms()
    adds = []
    for e in found:
        if stats[e.path]["numRecords"]:
            adds.append({"path": in_log(e.path), "partitionValues": values_of(e), "size": e.size, "modificationTime": modified, "dataChange": change, "stats": statistics_json(stats[e.path])})
        else:
            store.delete(e.path)
    return adds


def _statistics(spark: SparkSession, store: Store, paths: list[str]) -> dict[str, dict]:
    if len(paths) <= 4:
        return {p: footer_statistics(arrow_uri(store.url(p))) for p in paths}
    root = store.root

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f.path, "stats": [statistics_json(footer_statistics(arrow_uri(f"{root}/{p}"))) for p in f.path]})

    tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInPandas(run, "path string, stats string").collect()
    return {r["path"]: statistics_of({"stats": r["stats"]}) for r in rows}


def _file_key(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "file:/")


def file_url(store: Store, add: dict) -> str:
    """What _file_key gives for rows of the file."""
    logged = on_disk(add["path"])
    at = logged if "://" in logged or logged.startswith("file:/") else store.url(logged)
    return re.sub("^file:/+", "file:/", store.jvm.org.apache.hadoop.fs.Path(at).toUri().toString())


def is_live(spark: SparkSession, store: Store, adds: list[dict]):
    """A column function of (file, row): whether a row of one of these files is not deleted.

    Each task looks rows up in the vector of the file it reads, so that no row moves. What travels is the files'
    descriptors, which the snapshot has on the driver anyway.
    """
    root = arrow_uri(store.root)
    said = spark.sparkContext.broadcast({file_url(store, a): (store.url(on_disk(a["path"])), a["deletionVector"], statistics_of(a).get("numRecords")) for a in adds})

    def vector(file: str) -> dv.Vector:
        import pyarrow.parquet as pq
        from pyarrow import fs

        path, descriptor, n = said.value[file]
        own, base = fs.FileSystem.from_uri(root)
        gone = dv.vector_of(descriptor, lambda p, at, size: _read_at(own, f"{base}/{p}", at, size))
        own, at = fs.FileSystem.from_uri(arrow_uri(path))
        have = pq.read_metadata(at, filesystem=own).num_rows
        if (n is not None and int(n) != have) or gone.highest() >= have:
            raise DeltaError(f"{path}: the log and the file disagree on the number of rows")
        return gone

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        file, gone = None, None
        for files, rows in batches:
            out, at = np.ones(len(files), bool), rows.to_numpy(np.int64)
            names = files.to_numpy()
            cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if names[i] != file:
                    file, gone = names[i], vector(names[i])
                out[i:j] = ~gone.has(at[i:j])
            yield pd.Series(out)

    return F.pandas_udf(run, "boolean")


def _read_at(store, path: str, at: int, size: int) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def scan(spark: SparkSession, store: Store, s: Snapshot, adds: list[dict], places: bool = False, extra: T.StructType | None = None) -> DataFrame:
    """Rows of the files, without deleted ones, under the snapshot's logical schema.

    places: also __file and __row of each row. extra: further columns that the files have. Reading a table that maps
    columns by id switches spark.sql.parquet.fieldId.read.enabled on for the session, as Spark has no such reader option;
    it stays on, for frames are read later, and does nothing to schemas without ids.
    """
    schema, mode = s.schema, mode_of(s)
    extra = extra or T.StructType()
    partitions = {c.lower() for c in s.partition_columns}
    data = T.StructType([f for f in schema.fields if f.name.lower() not in partitions])
    stored = physical(data, mode)
    wanted = T.StructType([*(stored if mode == "id" else plain(stored)).fields, *extra.fields])  # without ids, names decide
    if not adds:
        return spark.createDataFrame([], T.StructType([*[T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields], *extra.fields, *([T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())] if places else [])]))
    if mode == "id":
        spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")

    def base(some: list[dict]) -> DataFrame:
        df = spark.read.schema(wanted).parquet(*[a["path"] if "://" in a["path"] else store.url(on_disk(a["path"])) for a in some])
        if places or any("deletionVector" in a and a["deletionVector"] for a in some) or values_by_join:
            df = df.select("*", _file_key(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row"))
        gone = [a for a in some if a.get("deletionVector")]
        return df.where(is_live(spark, store, gone)("__file", "__row")) if gone else df

    def logical(df: DataFrame, value_of) -> DataFrame:
        out = []
        for f in schema.fields:
            name = physical_name(f, mode)
            if f.name.lower() in partitions:
                c = value_of(name).cast(f.dataType)
            else:
                c = F.col(f"`{name}`")
                if plain(physical(f.dataType, mode)) != plain(f.dataType):
                    c = c.cast(plain(f.dataType))
            out.append(c.alias(f.name, metadata=f.metadata))
        return df.select(*out, *[F.col(f"`{f.name}`") for f in extra.fields], *([F.col("__file"), F.col("__row")] if places else []))

    groups: dict[tuple, list[dict]] = {}
    for a in adds:
        # files with and without deletion vectors apart, so that only the former pay for the mask
        groups.setdefault((tuple(sorted((a.get("partitionValues") or {}).items(), key=lambda x: x[0])), bool(a.get("deletionVector"))), []).append(a)
    values_by_join = len(groups) > SCANS
    if not values_by_join:
        parts = [logical(base(some), lambda name, v=dict(values): F.lit(v.get(name))) for (values, _), some in groups.items()]
    else:
        plain_files, masked = [a for a in adds if not a.get("deletionVector")], [a for a in adds if a.get("deletionVector")]
        named = spark.createDataFrame([(file_url(store, a), a.get("partitionValues") or {}) for a in adds], "f string, __values map<string,string>")
        parts = [logical(base(some).join(named, F.col("__file") == F.col("f")), lambda name: F.try_element_at("__values", F.lit(name))) for some in (plain_files, masked) if some]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# --- skipping -------------------------------------------------------------------------------------------------------


def conjuncts(spark: SparkSession, sql: str) -> list[tuple[str, str, object]]:
    """The (column, operator, value) conjuncts of a predicate that compare a column with a number or string, or with null."""
    out: list[tuple[str, str, object]] = []
    turned = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
    signs = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}

    def column(e):
        return e.name().replace("`", "") if e.getClass().getSimpleName() == "UnresolvedAttribute" else None

    def value(e):
        if e.getClass().getSimpleName() != "Literal":
            return None
        v, kind = e.value(), e.dataType().simpleString()
        if kind == "string":
            return v.toString() if v is not None else None
        if kind.startswith("decimal"):
            return decimal.Decimal(v.toString())
        return v if isinstance(v, int | float) and not isinstance(v, bool) and kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None

    def walk(e) -> None:
        kind, kids = e.getClass().getSimpleName(), [e.children().apply(i) for i in range(e.children().size())]
        if kind == "And":
            for k in kids:
                walk(k)
        elif kind in signs and len(kids) == 2:
            for a, b, op in ((kids[0], kids[1], signs[kind]), (kids[1], kids[0], turned[signs[kind]])):
                if column(a) and value(b) is not None:
                    out.append((column(a), op, value(b)))
        elif kind in ("IsNull", "IsNotNull") and column(kids[0]):
            out.append((column(kids[0]), kind, None))

    walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(sql))
    return out


def _partition_number(held: str, kind: T.DataType):
    """A partition value as a number; None for what is none. NaN is above all numbers, as it is for Spark."""
    try:
        if isinstance(kind, T.IntegralType):
            return int(held)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(held)
        out = float(np.float32(held)) if isinstance(kind, T.FloatType) else float(held)
    except (ValueError, decimal.InvalidOperation):
        return None
    return math.inf if out != out else out


def _comparable(v, low, high, kind: T.DataType) -> tuple | None:
    """(value, low, high) as Spark compares them: text as bytes, numbers exactly, but as doubles if either side is one; None: not compared here."""
    if isinstance(kind, T.StringType):
        return (v.encode(), low.encode(), high.encode()) if all(isinstance(x, str) for x in (v, low, high)) else None
    if not isinstance(kind, T.NumericType) or any(isinstance(x, bool) or not isinstance(x, int | float | decimal.Decimal) for x in (v, low, high)):
        return None
    if isinstance(v, float) or isinstance(kind, T.FloatType | T.DoubleType):
        return float(v), float(low), float(high)
    return v, low, high


def may_match(s: Snapshot, add: dict, tests: list[tuple[str, str, object]]) -> bool:
    """False only if no row of the file can satisfy all tests; without statistics: True."""
    fields, mode = {f.name.lower(): f for f in s.schema.fields}, mode_of(s)
    stats = statistics_of(add)
    for name, op, v in tests:
        f = fields.get(name.lower())
        if f is None:
            continue
        at = physical_name(f, mode)
        if f.name.lower() in {c.lower() for c in s.partition_columns}:
            held = (add.get("partitionValues") or {}).get(at)
            if op in ("IsNull", "IsNotNull"):
                if (held is None) != (op == "IsNull"):
                    return False
                continue
            if held is None:
                return False
            low = high = held if isinstance(f.dataType, T.StringType) else _partition_number(held, f.dataType)
        else:
            nulls, n = stats.get("nullCount", {}).get(at), stats.get("numRecords")
            if op == "IsNull":
                if nulls == 0:
                    return False
                continue
            if nulls is not None and n is not None and nulls == n:
                return False
            if op == "IsNotNull":
                continue
            low, high = stats.get("minValues", {}).get(at), stats.get("maxValues", {}).get(at)
        if (known := _comparable(v, low, high, f.dataType)) is None:
            continue
        v, low, high = known
        if op == "=" and not low <= v <= high or op == "<" and not low < v or op == "<=" and not low <= v or op == ">" and not high > v or op == ">=" and not high >= v:
            return False
    return True
