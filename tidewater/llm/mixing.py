"""Mixing sources to target weights, in words.

Each source is a line of words cut into blocks of fixed length. Output shards hold as many block slots each; how many
of a shard's slots go to each source is drawn as a multinomial conditioned on the sources' totals (so that these are
met), by halving the shards again and again with a generator seeded by the half. A source's slots, numbered through
all shards, go through a keyed permutation of its block numbers, a new one for each pass over the source; then slots
and documents meet by source and block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, dropped, stored, text_of, unused

#: Words of a block, slots of a shard, weights by rank of the source, share of all words that is drawn, passes at most.
BLOCK, SHARD, WEIGHTS, SHARE, PASSES = 1024, 1024, (3, 1, 2), 1.5, 2
SEED = 20
#: So many are drawn one by one.
FEW = 16


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: float = PASSES) -> list[float]:
    """share of all sizes by weight; no target above passes times its size, the excess going to the others by weight."""
    out, free, total = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / weight
        over = {i for i in free if out[i] > passes * sizes[i]}
        if not over:
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        free -= over
    return out


class Permutation:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the next power of four, walked until inside."""

    ROUNDS = 4

    def __init__(self, n: int, key: tuple[int, ...]):
        self.n, self.half = n, max(1, math.ceil(math.log2(max(n, 2)) / 2))
        self.keys = np.random.SeedSequence(list(key)).generate_state(self.ROUNDS, np.uint64)

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (x + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h >> np.uint64(31)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        s, m = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> s, x & m
        if not back:
            for k in self.keys:
                a, b = b, a ^ self._round(b, k)
        else:
            for k in self.keys[::-1]:
                a, b = b ^ self._round(a, k), a
        return (a << s) | b

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def rank_of(self, value: int) -> int:
        return int(self(np.array([value]), back=True)[0])


@dataclass(frozen=True)
class SourcePlan:
    """What one source gives: `slots` slots in all, each a whole block but the last, which has `last_words` words."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def plan_source(at: int, name: str | None, size: int, target: float, block: int, seed: int) -> SourcePlan:
    blocks, words = -(-size // block), min(round(target), PASSES * size)
    if not words:
        return SourcePlan(name, size, target, blocks, 0, 0)
    full, rest = divmod(words, size)
    short = size - (blocks - 1) * block
    if not rest:
        order = Permutation(blocks, (seed, at, full - 1))
        return SourcePlan(name, size, target, blocks, full * blocks, short if order.rank_of(blocks - 1) == blocks - 1 else block)
    rank = Permutation(blocks, (seed, at, full)).rank_of(blocks - 1)
    k = -(-rest // block)
    if rank < k:
        k = -(-(rest + block - short) // block)
    before = (k - 1) * block - (block - short if rank < k - 1 else 0)
    return SourcePlan(name, size, target, blocks, full * blocks + k, rest - before)


def draw(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among n drawn, without return, from have[i] of each: exact for numbers of any size.

    Each one of them is taken with chance n/total, a binomial draw per kind. What is then taken too much is a draw from
    those taken, what is too little one from the others; that is about the square root of n, and so on down to a few,
    which are drawn one by one.
    """
    total = int(have.sum())
    if 2 * n > total:
        return have - draw(have, total - n, rng)
    if n <= FEW:
        out = np.zeros_like(have)
        for _ in range(n):
            i = int(np.searchsorted(np.cumsum(have - out), rng.integers(total - int(out.sum())), "right"))
            out[i] += 1
        return out
    out = rng.binomial(have, n / total)
    short = n - int(out.sum())
    return out + draw(have - out, short, rng) if short > 0 else out - draw(out, -short, rng)


def shard_counts(totals: list[int], shards: int, slots: int, shard: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in this shard, slots of each source in the shards before it). known: keeps halvings for the next shards."""
    have, before, low, high = np.array(totals, np.int64), np.zeros(len(totals), np.int64), 0, shards
    known = {} if known is None else known
    while high - low > 1:
        mid = (low + high) // 2
        if (low, high) not in known:
            if len(known) >= 256:
                known.clear()
            known[low, high] = draw(have, (mid - low) * slots, np.random.default_rng([seed, low, high]))
        left = known[low, high]
        if shard < mid:
            have, high = left, mid
        else:
            have, before, low = have - left, before + left, mid
    return have, before


def _slots(spark: SparkSession, plans: list[SourcePlan], block: int, seed: int) -> DataFrame:
    """(shard, slot, s, pass, block, n): every slot of the mix with its source, block and words."""
    totals = [p.slots for p in plans]
    total = sum(totals)
    shards = max(1, -(-total // SHARD))
    pad = shards * SHARD - total  # the last shard's empty slots count as one more source

    def run(batches):
        orders: dict[tuple[int, int], Permutation] = {}
        known: dict = {}
        for b in batches:
            for shard in b.column(0).to_pylist():
                counts, before = shard_counts([*totals, pad], shards, SHARD, shard, seed, known)
                s = np.repeat(np.arange(len(plans)), counts[:-1])
                j = np.concatenate([np.arange(f, f + c) for c, f in zip(counts[:-1], before[:-1], strict=True)] or [np.zeros(0, np.int64)])
                out_pass, out_block, n = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
                for i in np.flatnonzero(counts[:-1]):
                    p, rows = plans[i], np.flatnonzero(s == i)
                    out_pass[rows] = j[rows] // p.blocks
                    for turn in np.unique(out_pass[rows]):
                        own = rows[out_pass[rows] == turn]
                        order = orders.setdefault((int(i), int(turn)), Permutation(p.blocks, (seed, int(i), int(turn))))
                        out_block[own] = order(j[own] % p.blocks)
                    n[rows] = np.minimum(block, p.size - out_block[rows] * block)
                    n[rows[j[rows] == p.slots - 1]] = p.last_words
                mixed = np.random.default_rng([seed, shard, 1]).permutation(len(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard)), pa.array(np.arange(len(s), dtype=np.int32)), *(pa.array(x[mixed]) for x in (s.astype(np.int32), out_pass.astype(np.int32), out_block, n))], names=["shard", "slot", "s", "pass", "block", "n"])

    tasks = min(shards, max(spark.sparkContext.defaultParallelism, shards // 64))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "shard long, slot int, s int, pass int, block long, n long")


@dataclass
class Mix:
    """rows: (rid, doc_id, s, size, start), one for each document; spans: (rid, s, shard, slot, pass, first, n), what the slots take of them."""

    rows: DataFrame
    spans: DataFrame
    plans: list[SourcePlan]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED, number_col: str | None = None) -> Mix:
    """Draws the mix. Sources (null is one, the last) go to the driver with their sizes; Spark sizes up their table itself.

    A source's documents lie in the order of a hash of id and size, then id, then size; rows equal in these are
    interchangeable. Empty and null texts have size 0 and are never taken. Rows without an id and repeated rows are rows
    like any other. Other columns are ignored. An empty table gives empty results.

    number_col: a column with another number for each row, which is then its rid; without it rows are numbered here.
    """
    spark = docs.sparkSession
    sized = docs.select((F.col(f"`{number_col}`") if number_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    sized = stored(sized, "sizes")
    totals = sorted(((r["source"], r["n"], r["size"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([t[2] for t in totals], [weights[i % len(weights)] for i in range(len(totals))])
    plans = [plan_source(i, name, size, goal[i], block, seed) for i, (name, _, size) in enumerate(totals)]
    number = F.lit(None).cast("int")
    if plans:
        named = spark.createDataFrame([(p.name, i) for i, p in enumerate(plans)], "source_ string, s int")
        rows = sized.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "source")
    else:
        rows = sized.drop("source").withColumn("s", number)
    # Prefix sums in two steps: within buckets of about the square root of the rows, and over the buckets. Rows with the
    # same id and size, be they a third of all, are dealt to as many cells and are a row per cell from the first aggregate on.
    n = sum(t[1] for t in totals)
    buckets = max(1, n // max(256, math.isqrt(n)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("rid"), F.lit(buckets)).cast("int"))
    cells = rows.groupBy("s", "doc_id", "size", "cell").agg(F.collect_list("rid").alias("rids"))
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)).cast("int")).withColumn("words", F.size("rids") * F.col("size"))
    inside = F.sum("words").over(Window.partitionBy("s", "bucket").orderBy("doc_id", "size", "cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    cells = stored(cells.withColumn("inside", inside), "cells")
    lengths = cells.groupBy("s", "bucket").agg(F.sum("words").alias("all"))
    before = lengths.select("s", "bucket", (F.sum("all").over(Window.partitionBy("s").orderBy("bucket")) - F.col("all")).alias("before"))
    each = cells.join(before, ["s", "bucket"]).select("doc_id", "s", "size", (F.col("before") + F.col("inside")).alias("first"), F.posexplode("rids").alias("at", "rid"))
    rows = stored(each.select("rid", "doc_id", "s", "size", (F.col("first") + F.col("at") * F.col("size")).alias("start")), "rows")
    dropped(sized)
    dropped(cells)
    at = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    slots = _slots(spark, plans, block, seed)
    first = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("n"))
    # the plan knows nothing of how many slots there are, so it must not take them for few
    spans = at.join(slots.hint("merge"), ["s", "block"]).where(end > first).select("rid", "s", "shard", "slot", "pass", (first - F.col("start")).alias("first"), (end - first).alias("n"))
    return Mix(rows, spans, plans)


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: for each pass over a document of which something is taken, a row with the text taken.

    A document taken whole keeps its text as it is; of others each run of words keeps its own blanks, and runs are
    joined by line feeds. A column n_chars, if there is one, is counted anew; all other columns stay, and no name
    clashes. Null and empty texts are never taken, so they have no row. Rows without an id or a source, repeated rows
    and ids are rows like any other. Bytes that are no UTF-8 count as U+FFFD. An empty table gives an empty result.

    `docs` is read once: its rows are stored with their numbers, by which the spans are joined to them.
    """
    names = docs.columns
    rid, taken = unused(names, "rid"), unused(names, "spans")
    numbered = stored(docs.select(F.monotonically_increasing_id().alias(rid), *[(text_of(f"`{c}`") if c == text_col else F.col(f"`{c}`")).alias(c) for c in names]), "numbered")
    m = mix(numbered, text_col=text_col, number_col=rid, **options)
    spans = m.spans.groupBy("rid").agg(F.collect_list(F.struct("pass", "first", "n")).alias("spans"))  # a few rows per block of the document
    spans = spans.select(F.col("rid").alias(rid), F.col("spans").alias(taken))
    joined = numbered.join(spans, rid).select(*[F.col(f"`{c}`") for c in names], taken)
    schema = joined.select(*[F.col(f"`{c}`") for c in names]).schema

    def cut(text: str, spans: list[dict]) -> Iterator[str]:
        data, words = text.encode(), None
        for turn in sorted({s["pass"] for s in spans}):
            runs: list[list[int]] = []
            for first, n in sorted((s["first"], s["n"]) for s in spans if s["pass"] == turn):
                if runs and runs[-1][1] == first:
                    runs[-1][1] = first + n
                else:
                    runs.append([first, first + n])
            words = words or [w.span() for w in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            if runs == [[0, len(words)]]:
                yield text
            else:
                yield b"\n".join(data[words[a][0] : words[b - 1][1]] for a, b in runs).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for i, (t, s) in enumerate(zip(b.column(names.index(text_col)).to_pylist(), b.column(len(names)).to_pylist(), strict=True)):
                for x in cut(t, s):
                    at.append(i)
                    texts.append(x)
            out = b.select(range(len(names))).take(pa.array(at, pa.int32()))
            columns = list(out.columns)
            columns[names.index(text_col)] = pa.array(texts, out.schema.field(names.index(text_col)).type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array(list(map(len, texts)), out.schema.field(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = m.spans.groupBy("rid").agg(F.sum("n").alias("taken"))
    named = spark.createDataFrame([(i, p.size, float(p.target)) for i, p in enumerate(m.plans)], "s int, source_size long, target double")
    return m.rows.join(taken, "rid", "left").join(named, "s").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
