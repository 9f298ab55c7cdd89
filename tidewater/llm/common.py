"""Shared helpers: shared-folder tables, connected components, splits by crc32."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` is what bytes.split() yields; this is the class for Spark's regular expressions.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or, where it is unset and all runs on one machine, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: df written as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Removes what stored() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def text_of(column: str) -> Column:
    """The column as text; bytes that are no UTF-8 become U+FFFD, as they would wherever they are decoded."""
    return F.make_valid_utf8(F.col(column).cast("string"))


def unused(names: list[str], want: str) -> str:
    """want, or with so many underscores behind it that no column is called like it."""
    taken = {n.lower() for n in names}
    while want in taken:
        want += "_"
    return want


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def of_worker(key: str, make):
    """One object for all tasks of a Python worker, until released()."""
    held = sys.modules.setdefault("_tidewater_worker", types.ModuleType("_tidewater_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def released() -> None:
    """Lets go of what of_worker() keeps: workers are used again, and another operator's tables would stay beside one's own."""
    sys.modules.pop("_tidewater_worker", None)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps. Each step takes a minimum per node (combined before the
    shuffle) and joins it back; the minima are stored first, so that both join sides are plain shuffles
    which adaptive execution splits at a hub node. No node's neighbours are ever gathered. A round begins with the
    count of smaller neighbours per node, taken along with the minima: if no node has two of them, or one and a larger
    neighbour as well, each edge leads to its part's least node and nothing is left to do.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.max("v").alias("most"))
        low = stored(low, "low")
        if low.where("below > 1 or below = 1 and most > u").isEmpty():
            dropped(low)
            break
        large = both.where("v > u").join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e1 = stored(large.distinct(), "large")
        low2 = stored(e1.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = e1.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
        e2 = stored(small.distinct(), "edges")
        for old in (e, low, e1, low2):
            dropped(old)
        e = e2
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    out._stored_at = e._stored_at  # so that dropped() can be called on it
    return out


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the least member of its part, if links a-b are all there is."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = np.array(parent, np.int64)
    while (out[out] != out).any():
        out = out[out]
    return out
