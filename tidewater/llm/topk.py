"""Exact top-k by inner product: columnar branch and bound.

The queries come in blocks of a bounded size; each block is broadcast and the rows are scanned where they lie, in blocks
held vertically, one line per dimension. Scores grow dimension block by dimension block; a candidate whose score so far
plus the most that the rest can add (the product of what remains of both norms) is below what its query is known to
reach is dropped, and the survivors are compacted. Known from the start is the k-th best among one row in ROOT, so that
tasks hand on little besides the results; that only bounds, and all rows are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, stored

#: Queries of a block at most, and bytes of their components; queries, rows and dimensions that are worked on at a time.
QUERIES, QUERY_BYTES, TILE, ROWS, DIMS = 16_384, 16 << 20, 1024, 4096, 16
#: One row in so many gives the first bounds.
ROOT = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1
FOUND = ["q", "query_id", "itself", "vec_id", "score"]


def _scaled(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, vectors): floor(1024 x) as doubles (whole numbers) of the rows that take part."""
    values, offsets, valid = column.values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    x = np.floor(1024.0 * values.to_numpy(zero_copy_only=False).astype(np.float64))  # nulls become NaN
    bad = np.r_[0, np.cumsum(~np.isfinite(x))]
    at = np.flatnonzero(valid & (bad[offsets[1:]] == bad[offsets[:-1]]))
    return at, [x[i:j] for i, j in zip(offsets[at].tolist(), offsets[at + 1].tolist(), strict=True)]


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers of any size, held within a long."""
    return min(max(sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), LOW), HIGH)


class Cell:
    """The running k best rows of each of some queries, of those that reach `least`."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray):
        self.q, self.k, self.least, self.dims = queries, k, least.copy(), queries.shape[1]
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in queries]
        self.rest = self._rest(queries)

    @staticmethod
    def _rest(m: np.ndarray) -> np.ndarray:
        """The norm of what follows, at each dimension."""
        return np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        most = np.abs(x).max(initial=0) * np.abs(self.q).max(initial=0) * max(self.dims, 1)
        if most >= 2.0**52:
            return self._take_exactly(ids, x)
        vertical = np.ascontiguousarray(x.T)
        rest_x = self._rest(x)
        first = self.q[:, :DIMS] @ vertical[:DIMS]
        for i in range(len(self.q)):
            alive, part = np.arange(len(x)), first[i]
            for cut in range(DIMS, self.dims, DIMS):
                if self.least[i] > -np.inf:
                    # the margin covers the rounding of the two norms; a tie must survive
                    keep = np.flatnonzero(part + self.rest[i, cut] * rest_x[alive, cut] * (1 + 1e-9) + 1e-6 >= self.least[i])
                    alive, part = alive[keep], part[keep]
                    if not len(alive):
                        break
                part = part + self.q[i, cut : cut + DIMS] @ vertical[cut : cut + DIMS, alive]
            self._merge(i, part, ids[alive])

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least[i]
        if not keep.any():
            return
        score, ids = np.concatenate([self.best[i][0], score[keep]]), np.concatenate([self.best[i][1], ids[keep]])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[i] = score[order], ids[order]
        if len(order) == self.k:
            self.least[i] = score[order[-1]]

    def _take_exactly(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Components too large for exact doubles: whole numbers of any size, scores held within a long."""
        for i, q in enumerate(self.q):
            found = [(_exact(q, w), int(d)) for w, d in zip(x, ids, strict=True)]
            found += [(int(s), int(d)) for s, d in zip(*self.best[i], strict=True)]
            found = sorted(found, key=lambda f: (-f[0], f[1]))[: self.k]
            self.best[i] = np.array([f[0] for f in found], object), np.array([f[1] for f in found], np.int64)
            if len(found) == self.k:
                self.least[i] = max(self.least[i], float(found[-1][0]))


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    """Missing trailing components are 0."""
    if all(len(v) == dims for v in vectors):
        return np.array(vectors).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:dims]
    return out


@dataclass
class Block:
    """Some queries: numbers, ids, scores with themselves, components, and what their k best reach at least."""

    number: np.ndarray
    ids: np.ndarray
    itself: list[int]
    vectors: np.ndarray
    least: np.ndarray


def _searched(rows: DataFrame, block, k: int) -> DataFrame:
    """(q, query_id, itself, vec_id, score): of each task's rows (vec_id, v) the k best for each query of the block that reach its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        cells = [(at, Cell(own.vectors[at : at + TILE], k, own.least[at : at + TILE])) for at in range(0, len(own.ids), TILE)]
        for b in batches:
            at, vectors = _scaled(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)[at]
            for s in range(0, len(at), ROWS):
                x = _matrix(vectors[s : s + ROWS], own.vectors.shape[1])
                for _, c in cells:
                    c.take(ids[s : s + ROWS], x)
        for first, c in cells:
            q = np.repeat(np.arange(len(c.best)), [len(ids) for _, ids in c.best]) + first
            if len(q):
                score = [int(x) for s, _ in c.best for x in s.tolist()]
                columns = [own.number[q], own.ids[q], [own.itself[i] for i in q.tolist()], np.concatenate([ids for _, ids in c.best]), score]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=FOUND)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def _bounds(sample: DataFrame, block, k: int) -> DataFrame:
    """(q, least): the score of the k-th best row of a sample, for queries that have one."""
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    return _searched(sample, block, k).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("q", F.col("score").alias("least"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query without its own row.

    Rows that have the query's id and score are alike in the result, so that one of them goes, whichever it was.
    """
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    twin = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("itself"))
    found = found.withColumn("twin", twin).withColumn("own", F.col("twin") & ~F.coalesce(F.lag("twin").over(by), F.lit(False)))
    before = F.sum(F.col("own").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("rank", (F.row_number().over(by) - before).cast("int"))
    return found.where(~F.col("own") & (F.col("rank") <= k)).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best other rows.

    Score: inner product of floor(1024 x); ties go to the smaller vec_id. Vectors null or holding a null or non-finite
    component take no part, nor do rows without an id. Vectors of unequal length count as filled up with zeros. A
    repeated row is a candidate for its twin, and a repeated query gets rows of its own. Scores beyond a long stop at
    its bounds. Fewer candidates than k give as many rows; an empty table gives none. Other columns are ignored.

    Each block of queries is a pass over the rows, which are not shuffled; of a task at most k + 1 rows a query are.
    """
    spark, form = vectors.sparkSession, "vec_id long, v array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    queries = rows.where(F.col("vec_id") % every == 0)
    n, dims = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    # a file holds a block at most: what is collected and broadcast at a time is bounded in rows and bytes
    most = max(1, min(QUERIES, QUERY_BYTES // (8 * max(dims or 1, 1))))
    dealt = new_path(spark, "queries")
    queries.repartition(max(1, -(-n // most))).write.option("maxRecordsPerFile", most).parquet(dealt)
    sample = stored(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(ROOT)) == 0), "sample")
    passes: list[DataFrame] = []
    for at, file in enumerate(sorted(spark.read.schema(form).parquet(dealt).inputFiles())):
        table = spark.read.schema(form).parquet(unquote(file)).toArrow()
        v = table.column("v")
        ok, own = _scaled(pa.concat_arrays(v.chunks) if v.num_chunks else pa.array([], pa.list_(pa.float64())))
        if not len(ok):
            continue
        block = Block(at * most + np.arange(len(ok)), table.column("vec_id").to_numpy()[ok], [_exact(x, x) for x in own], _matrix(own, max(map(len, own))), np.full(len(ok), -np.inf))
        sent = spark.sparkContext.broadcast(block)
        known = _bounds(sample, sent, k + 1).toArrow()  # a row per query of the block
        sent.destroy()
        # one step down, as a long may have been rounded up
        block.least[known.column("q").to_numpy() - at * most] = np.nextafter(known.column("least").to_numpy().astype(float), -np.inf)
        sent = spark.sparkContext.broadcast(block)
        passes.append(stored(_searched(rows, sent, k + 1), "found"))
        sent.destroy()
    dropped(sample)
    form = ", ".join(f"{c} long" for c in FOUND)
    return _ranked(spark.read.schema(form).parquet(*[p._stored_at for p in passes]) if passes else spark.createDataFrame([], form), k)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid AS qrid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
