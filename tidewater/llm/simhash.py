"""SimHash near-dedup by the generalised pigeonhole principle.

Correlated bits of the fingerprints share a partition; a dynamic programme on candidate counts (exact ones, from
the histograms of the partitions' values) gives each partition its own threshold. Two fingerprints within `radius`
bits agree to within the threshold in at least one partition, so each fingerprint probes there, and every candidate
pair is verified on all 64 bits. Equal fingerprints are one row from the first aggregate on; a bucket of many
different fingerprints is cut into blocks whose pairs are compared cell by cell, so neither a copy group nor a
bucket meets in one task. A cell never holds or hands on its pairs, only which parts of it they join: a star per part,
and of two blocks, whose own parts other cells hand on, just what joins parts of the one to parts of the other. The stage
that keeps one document of each group compares a few partitions first and names what they connect, so that the cells
of the others do not hand it on again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, released, roots_of, stored, text_bytes, unused

#: Rows of one bucket that are compared within one cell: a thousandth of all probes within these bounds. Larger buckets
#: are cut into blocks of that size.
BLOCK, BLOCK_MOST = 1024, 65_536
#: Rows and columns of a strip of comparisons.
STRIP, COLUMNS = 256, 16_384
#: Shingle sets of a block, and bytes of their hashes on average.
SETS, SET_BYTES = 256, 16 << 20
#: What a shuffled probe row and a verified pair cost, in seconds; only their ratio matters to the plan.
ROW_COST, PAIR_COST = 4e-6, 8e-9
#: Partitions whose equal values are compared before all others, so that their links need not be handed on by each cell.
FIRST = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second hash out of the first."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, lower-cased, in turn; of a shorter text one for all its words. No word: none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(w))
    first, last = start[: len(w) - k + 1], (start + size)[k - 1 :]
    out = []
    for at in range(0, len(first), 1 << 17):
        cut = [joined[i:j] for i, j in zip(first[at : at + (1 << 17)].tolist(), last[at : at + (1 << 17)].tolist(), strict=True)]
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(42)), np.uint64, len(cut)))
    return np.concatenate(out)


def _majority(hashes: np.ndarray, halves: int) -> list[int]:
    """A bit is 1 if set in over half the hashes; the second half is of another mix of them."""
    ones = np.zeros((halves, 64), np.int64)
    for at in range(0, len(hashes), 1 << 17):
        h = hashes[at : at + (1 << 17)]
        for half in range(halves):
            ones[half] += np.add.reduce(_bits(h[:, None]), axis=0, dtype=np.int64)
            h = _mixed(h) if halves > 1 else h
    return [int.from_bytes(np.packbits(2 * o > len(hashes), bitorder="little").tobytes(), "little") for o in ones]


def fingerprint(text: bytes, words: int = 4, halves: int = 1) -> list[int]:
    """Unsigned SimHash of one text, 64 bits a half: a bit is 1 if set in over half the shingles' hashes. No word: 0.

    The first half is of the shingles' XXH64 (seed 42), the second of another mix of that.
    """
    return _majority(shingles(text, words), halves)


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1, least bit first, of an array (n, halves)."""
    return np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")


def _names(halves: int) -> list[str]:
    return ["fp", "fp2"][:halves]


def _halves(b: pa.RecordBatch, at: int, halves: int) -> np.ndarray:
    """Columns at, at + 1 ... as an array (n, halves) of uint64."""
    return np.stack([b.column(at + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(halves)], axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, halves: int = 1) -> DataFrame:
    """(doc_id, fp[, fp2]): the fingerprint as signed longs. Null text is empty; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, words, halves) for t in text_bytes(b.column(1))], np.uint64).reshape(-1, halves).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(halves))], names=["doc_id", *_names(halves)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *_names(halves)]))


def _together(fps: DataFrame, halves: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both: a row per bit, whatever the input."""
    n = 64 * halves

    def run(batches):
        g = np.zeros((n, n))
        for b in batches:
            bits = _bits(_halves(b, 0, halves)).astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                g += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(g.tolist())], names=["i", "c"])

    rows = fps.select(*_names(halves)).mapInArrow(run, "i int, c array<double>").groupBy("i").agg(*[F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(n)]).collect()
    g = np.zeros((n, n))
    for r in rows:
        g[r["i"]] = [r[f"c{j}"] or 0 for j in range(n)]
    return fps.count(), g


def group_bits(n: int, g: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in `parts` groups of near-equal size, correlated bits together."""
    p = np.diag(g) / max(n, 1)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    corr = np.abs((g / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(len(g))), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(b := max(sorted(free), key=lambda b: corr[b, group].sum()))
            free.discard(b)
        out.append(sorted(group))
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, an array (n, halves), packed."""
    v = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        v |= ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << k
    return v


def _histograms(fps: DataFrame, groups: list[list[int]], halves: int) -> list[np.ndarray]:
    """For each group, how many fingerprints have each value: 2^len(group) counts, whatever the input."""

    def run(batches):
        c = [np.zeros(1 << len(g), np.int64) for g in groups]
        for b in batches:
            fp = _halves(b, 0, halves)
            for k, g in enumerate(groups):
                c[k] += np.bincount(values(fp, g), minlength=1 << len(g))
        for k, x in enumerate(c):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["g", "v", "c"])

    t = fps.select(*_names(halves)).mapInArrow(run, "g int, v int, c long").groupBy("g", "v").agg(F.sum("c").alias("c")).toArrow().to_pydict()
    out = [np.zeros(1 << len(g), np.int64) for g in groups]
    g, v, c = (np.array(t[k], np.int64) for k in "gvc")
    for k, x in enumerate(out):
        x[v[g == k]] = c[g == k]
    return out


def near(count: np.ndarray, radius: int, upward: bool = False) -> np.ndarray:
    """For each value, how many fingerprints have one within radius bits of it (upward: just those at or below it)."""
    w, at, out = len(count).bit_length() - 1, np.arange(len(count)), np.zeros(len(count), np.int64)
    for r in range(radius + 1):
        for flip in combinations(range(w), r):
            u = at ^ sum(1 << b for b in flip)
            out += np.where(u <= at, count[u], 0) if upward else count[u]
    return out


def candidates(count: np.ndarray, radius: int) -> float:
    """Pairs of fingerprints whose values in this partition differ in at most radius bits."""
    return float(count.astype(float) @ near(count, radius)) / 2


def allocate(counts: list[np.ndarray], radius: int) -> tuple[float, list[int]]:
    """(cost, thresholds): t_i >= -1 with sum(t_i + 1) = radius + 1 at the least cost, by dynamic programming."""
    best = {0: (0.0, [])}
    for c in counts:
        w, n = len(c).bit_length() - 1, float(c.sum())
        cost = {-1: 0.0}
        for t in range(min(radius, 2) + 1):
            cost[t] = n * ROW_COST * sum(len(list(combinations(range(w), r))) for r in range(t + 1)) / (2 if t else 1) + PAIR_COST * candidates(c, t)
        step = {}
        for used, (so_far, ts) in best.items():
            for t, x in cost.items():
                if (u := used + t + 1) <= radius + 1 and (u not in step or so_far + x < step[u][0]):
                    step[u] = (so_far + x, [*ts, t])
        best = step
    return best.get(radius + 1, (float("inf"), []))


def plan(fps: DataFrame, radius: int, halves: int = 1) -> tuple[list[list[int]], list[int], list[np.ndarray]]:
    """Groups of bits, their thresholds and the histograms, of the number of partitions that costs least."""
    n, g = _together(fps, halves)
    fewest, most = max(4 * halves, -(-(radius + 1) // 3)), max(5 * halves, -(-(radius + 1) // 2))
    tries = [group_bits(n, g, m) for m in range(fewest, most + 1)]
    counts, at, found = _histograms(fps, [x for t in tries for x in t], halves), 0, []
    for t in tries:
        own, at = counts[at : at + len(t)], at + len(t)
        cost, ts = allocate(own, radius)
        found.append((cost, t, ts, own))
    _, groups, ts, own = min(found, key=lambda x: x[0])
    return groups, ts, own


def _probes(fps: DataFrame, groups, ts, counts, halves: int) -> DataFrame:
    """(k, and the columns of fps, which begin with the fingerprint): each fingerprint at home, under its own value of each partition with a threshold, and as a visitor at the larger values near it.

    k: partition, value, the two blocks of the cell, 1 for visitors, and 1 for rows of the higher block, from the highest
    bit down.
    """
    held = [near(c, t, True) if t >= 0 else np.zeros(1, np.int64) for c, t in zip(counts, ts, strict=True)]
    block = min(BLOCK_MOST, max(BLOCK, sum(int(h[c > 0].sum()) for h, c in zip(held, counts, strict=True) if len(h) > 1) // 1000))
    blocks = [np.maximum(1, -(-h // block)) for h in held]
    names = ["k", *fps.columns]

    def run(batches):
        for b in batches:
            fp, columns = _halves(b, 0, halves), [c.to_numpy(zero_copy_only=False) for c in b.columns]
            for part, (bits, t) in enumerate(zip(groups, ts, strict=True)):
                if t < 0:
                    continue
                v = values(fp, bits)
                for r in range(t + 1):
                    for flip in combinations(range(len(bits)), r):
                        u = v ^ sum(1 << x for x in flip)
                        rows = np.arange(len(v)) if not r else np.flatnonzero((u > v) & (counts[part][u] > 0))
                        if not len(rows):
                            continue
                        u = u[rows]
                        g = blocks[part][u]
                        own = ((fp[rows, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % g
                        at = np.repeat(np.arange(len(u)), g)
                        other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
                        low, high = np.minimum(own[at], other), np.maximum(own[at], other)
                        key = (part << 57) | (u[at] << 41) | (low << 22) | (high << 2) | (int(r > 0) << 1) | (own[at] > low)
                        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[rows[at]]) for c in columns)], names=names)

    return fps.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; the last axis is that of the halves."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0])
    for k in range(1, x.shape[-1]):
        out = out + np.bitwise_count(x[..., k] ^ y[..., k])
    return out


def parts_of(fp: np.ndarray, home: int, radius: int, side: np.ndarray, size: np.ndarray | None = None, similarity: float = 0.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): for each row of a cell the number of the part that pairs within radius join it to; the first `home` rows are compared with all.

    side: which of the cell's two blocks a row is of. before: joined by pairs of one block, if there are two (those are
    another cell's to hand on); after: by all. size: of the rows' sets, growing among the home rows and among the others.
    Sets of this Jaccard similarity are at most 1/similarity times as large as one another, so that a strip of home rows
    need only be compared with a run of rows. known: for each row the first of those that it is known to be linked with.
    """
    known = np.arange(len(fp)) if known is None else known
    label, joined = known.copy(), np.zeros(len(fp), bool)

    def compare(rows: np.ndarray, columns: np.ndarray) -> None:
        for at in range(0, len(rows), STRIP):
            i = rows[at : at + STRIP]
            first, last = at if rows is columns else 0, len(columns)
            if size is not None and last:
                low, high = size[i[0]] * similarity * (1 - 1e-9), size[i[-1]] / similarity * (1 + 1e-9)
                first, last = max(first, int(np.searchsorted(size[columns], low, "left"))), int(np.searchsorted(size[columns], high, "right"))
            for c in range(first, last, COLUMNS):
                j = columns[c : min(c + COLUMNS, last)]
                if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
                    continue
                hit = (apart(fp[i, None], fp[None, j]) <= radius) & (label[i, None] != label[None, j])
                for x in np.flatnonzero(hit.any(axis=1)).tolist():
                    others = label[j[hit[x]]]
                    joined[others] = True
                    label[joined[label]] = label[i[x]]
                    joined[others] = False

    at = np.arange(len(fp))
    (h0, v0), (h1, v1) = ((np.flatnonzero((side == s) & (at < home)), np.flatnonzero((side == s) & (at >= home))) for s in (0, 1))
    if not len(h1) + len(v1):
        compare(h0, h0)
        compare(h0, v0)
        return known, label
    for h, v in ((h0, v0), (h1, v1)):
        compare(h, h)
        compare(h, v)
    before = label.copy()
    compare(h0, h1)
    compare(h0, v1)
    compare(h1, v0)
    return before, label


def stars(node: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that make the parts `after` of the parts `before`, each part named by its least node: all to the least one.

    The same least node in many cells gives the same links, which the first aggregate makes one.
    """
    old, own = np.unique(before, return_inverse=True)
    name, whole = np.full(len(old), np.iinfo(np.int64).max), np.zeros(len(old), np.int64)
    np.minimum.at(name, own, node)
    whole[own] = after
    new, at = np.unique(whole, return_inverse=True)
    least = np.full(len(new), np.iinfo(np.int64).max)
    np.minimum.at(least, at, name)
    other = name != least[at]
    return least[at][other], name[other]


def _verified(probes: DataFrame, radius: int, halves: int, similarity: float = 0.0) -> DataFrame:
    """(a, b): cell by cell, links that connect what the pairs within radius bits connect of which one at least is at home.

    Rows are named by the column `node`, or by the fingerprint if there is none; with a column `size`, sets that cannot
    have the similarity are not compared. Rows of one name are known to be linked, and nothing is handed on to say so.
    """
    names = probes.columns
    node, sized = names.index("node" if "node" in names else "fp"), "size" in names

    def first_of_name(cell: np.ndarray, name: np.ndarray) -> np.ndarray:
        """For each row the first of its cell with its name."""
        order = np.lexsort((name, cell))
        new = np.r_[True, (cell[order][1:] != cell[order][:-1]) | (name[order][1:] != name[order][:-1])]
        out = np.empty(len(cell), np.int64)
        out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return out

    def small(cell: np.ndarray, home: np.ndarray, fp: np.ndarray, size: np.ndarray | None, each: np.ndarray, start: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Parts of the small cells, all at once by growing offset."""
        again = np.flatnonzero(known != np.arange(len(cell)))
        i_all, j_all = [again], [known[again]]
        left = np.repeat(start + each, each) - np.arange(len(cell)) - 1  # rows of the same cell that follow
        idx, k = np.flatnonzero(np.repeat(each <= 64, each) & (left > 0) & home), 1
        while len(idx):
            hit = idx[apart(fp[idx], fp[idx + k]) <= radius]
            if size is not None:
                hit = hit[np.minimum(size[hit], size[hit + k]) >= np.maximum(size[hit], size[hit + k]) * similarity * (1 - 1e-9)]
            i_all.append(hit)
            j_all.append(hit + k)
            k += 1
            idx = idx[left[idx] >= k]
        return roots_of(len(cell), np.concatenate(i_all), np.concatenate(j_all))

    def work(columns: list[np.ndarray]) -> pa.RecordBatch:
        cell, home, side = columns[0] >> 2, (columns[0] & 2) == 0, columns[0] & 1
        fp, size = np.stack([x.view(np.uint64) for x in columns[1 : 1 + halves]], axis=1), columns[names.index("size")] if sized else None
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        each = np.diff(np.r_[start, len(cell)])
        before = first_of_name(cell, columns[node]) if names[node] == "node" else np.arange(len(cell))  # a cell has no fingerprint twice
        after = small(cell, home, fp, size, each, start, before)
        for s, n in zip(start[each > 64].tolist(), each[each > 64].tolist(), strict=True):
            own = slice(s, s + n)
            b, a = parts_of(fp[own], int(home[own].sum()), radius, side[own], None if size is None else size[own], similarity, before[own] - s)
            before[own], after[own] = b + s, a + s
        a, b = stars(columns[node], before, after)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        released()
        rest: list[np.ndarray] = []
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = np.flatnonzero(now[0] >> 2 != now[0][-1] >> 2)
            cut = cut[-1] + 1 if len(cut) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield work([x[:cut] for x in now])
        if rest and len(rest[0]):
            yield work(rest)

    return probes.repartition(F.shiftright("k", 2)).sortWithinPartitions(F.shiftright("k", 1), *["size"][: int(sized)]).mapInArrow(run, "a long, b long")


def _crowds(points: DataFrame, radius: int, halves: int, similarity: float) -> DataFrame:
    """(node, root) for every node with a pair within radius bits: what such pairs connect, named by its least node.

    Near copies meet in most partitions, where every cell would hand on much the same links again. So the equal values of
    a few partitions come first. What these connect has one name when all partitions are compared, as they are whatever
    the first ones find, and only links between different names are handed on.
    """
    groups, ts, counts = plan(points, radius, halves)
    few = sorted(range(len(groups)), key=lambda k: candidates(counts[k], 0))[:FIRST]
    links = stored(_verified(_probes(points, groups, [0 if k in few else -1 for k in range(len(groups))], counts, halves), radius, halves, similarity), "links")
    known = components(links)
    named = points.join(known, "node", "left").withColumn("node", F.coalesce("root", "node")).select(*points.columns)
    rest = stored(_verified(_probes(named, groups, ts, counts, halves), radius, halves, similarity), "links")
    out = components(rest.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    for old in (links, known, rest):
        dropped(old)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, halves: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents linked, directly or not, by fingerprints within radius bits.

    halves: 64-bit halves of a fingerprint; with two, radius is of all 128 bits, and the column fp2 follows fp.

    component_id is the smallest doc_id reachable. Repeated rows stay, each with its own result row. Empty and null
    texts have fingerprint 0 and link like any other. A row without doc_id links too; its component_id is null only if
    nothing in its component has an id. Other columns are ignored. An empty table gives an empty result.
    """
    names = _names(halves)
    fps = stored(fingerprints(docs, id_col, text_col, words, halves), "fps")
    one = fps.groupBy(*names).agg(F.min("doc_id").alias("rep"))
    # numbers for whole fingerprints, given once and kept, so that they mean the same in all that follows
    one = stored(one.select("*", F.monotonically_increasing_id().alias("node")) if halves > 1 else one, "distinct")
    if one.isEmpty():
        return fps.withColumn("component_id", F.lit(None).cast("long"))
    points, node = one.drop("rep"), "node" if halves > 1 else "fp"
    links = stored(_verified(_probes(points, *plan(points, radius, halves), halves), radius, halves), "links")
    connected = components(links)
    rooted = stored(one.join(connected.withColumnRenamed("node", node), node, "left").select(*names, "rep", F.coalesce("root", node).alias("root")), "roots")
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    out = stored(fps.join(rooted.join(least, "root").select(*names, "component_id"), names).select("doc_id", *names, "component_id"), "near")
    for old in (fps, one, links, connected, rooted, least):
        dropped(old)
    return out


def candidate_radius(similarity: float, bits: int = 128, deviations: float = 4.0) -> int:
    """Bits that fingerprints of two sets of this Jaccard similarity differ in, so many standard deviations above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sets of at least this Jaccard similarity; of a cell, so at most some 500 sets."""
    m, size = len(sets), np.array(list(map(len, sets)), np.int64)
    i_all, j_all = [np.zeros(0, int)], [np.zeros(0, int)]
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    held = every[order]
    start = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, int)
    times = np.diff(np.r_[start, len(held)])
    number = np.empty(len(every), np.int64)
    number[order] = np.repeat(np.arange(len(start)), times)
    owner, at = np.repeat(np.arange(m), size)[order], np.cumsum(size) - size
    for i in range(m - 1):
        u = number[at[i] : at[i] + size[i]]
        n = times[u]
        both = np.bincount(owner[np.arange(n.sum()) + np.repeat(start[u] - np.cumsum(n) + n, n)], minlength=m)
        found = both / np.maximum(size[i] + size - both, 1) >= similarity
        found[: i + 1] = False
        j = np.flatnonzero(found)
        i_all.append(np.full(len(j), i))
        j_all.append(j)
    return np.concatenate(i_all), np.concatenate(j_all)


def _similar(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): cell by cell, links that connect what the pairs of the same `root` with similar shingle sets connect; sets: (root, rid, hashes)."""
    n = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes")).alias("bytes"))
    g = stored(n.where("n > 1").select("root", F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("bytes") / SET_BYTES)).cast("int").alias("g")), "blocks")
    own = F.pmod(F.xxhash64("rid"), F.col("g")).cast("int")
    cells = sets.join(g, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rid", "hashes")

    def work(own: list[int], rid: list[int], hashes: list[bytes]) -> pa.RecordBatch:
        i, j = alike([np.frombuffer(x, "<u8") for x in hashes], similarity)
        own, rid, before = np.array(own), np.array(rid, np.int64), np.arange(len(rid))
        if len(np.unique(own)) > 1:  # what is of one block is another cell's to hand on
            inside = own[i] == own[j]
            before = roots_of(len(rid), i[inside], j[inside])
        a, b = stars(rid, before, roots_of(len(rid), i, j))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, cell in groupby(rows, lambda r: r[:3]):
            yield work(*zip(*(r[3:] for r in cell), strict=True))

    return cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(run, "a long, b long")


def one_of_each_group(docs: DataFrame, text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without those that have a near duplicate on an earlier row; all columns stay.

    Near duplicates: the sets of shingles have at least this Jaccard similarity, counted exactly (shingles are told apart
    by their XXH64), or are linked by others that do. 128-bit fingerprints of the sets only find the candidates, within
    candidate_radius() bits; texts of one set are one from the first aggregate on. Candidates that hang together meet in
    cells of two blocks of sets.

    Null texts, empty ones and texts of blanks have the empty set and are one group; a text of fewer words than a shingle
    has one shingle. Rows without an id, repeated rows and ids are rows like any other. No column name clashes. An empty
    table gives an empty result.

    `docs` is read once: its rows are stored with their numbers, by which what goes is joined against, so that Spark
    broadcasts it if it is small and the texts are shuffled only if it is not.
    """
    names, rid = [F.col(f"`{c}`") for c in docs.columns], unused(docs.columns, "rid")
    numbered = stored(docs.select(F.monotonically_increasing_id().alias(rid), *names), "numbered")
    radius = candidate_radius(similarity)

    def points(batches):
        released()
        for b in batches:
            keys, fps, sizes = [], [], []
            for t in text_bytes(b.column(1)):
                s = np.unique(shingles(t, words))
                keys.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest())
                fps.append(_majority(s, 2))
                sizes.append(len(s))
            f = np.array(fps, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(2)), pa.array(sizes, pa.int64())], names=["rid", "key", "fp", "fp2", "size"])

    def hashes(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([np.unique(shingles(t, words)).astype("<u8").tobytes() for t in text_bytes(c.column(2))], pa.binary())], names=["root", "rid", "hashes"])

    text = numbered.select(F.col(rid).alias("rid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = stored(text.mapInArrow(points, "rid long, key binary, fp long, fp2 long, size long"), "texts")
    one = stored(texts.groupBy("key").agg(*[F.min(c).alias(c) for c in ("fp", "fp2", "rid", "size")]), "distinct")
    if one.isEmpty():
        return numbered.select(*names)
    fps = one.select("fp", "fp2", F.col("rid").alias("node"), "size")
    crowds = _crowds(fps, radius, 2, similarity)
    sets = stored(text.join(crowds.withColumnRenamed("node", "rid"), "rid").select("root", "rid", "text").mapInArrow(hashes, "root long, rid long, hashes binary"), "sets")
    similar = stored(_similar(sets, similarity), "links")
    groups = components(similar)
    gone = one.select("key", F.col("rid").alias("node")).join(groups, "node", "left").select("key", F.coalesce("root", "node").alias("first"))
    gone = stored(texts.select("key", "rid").join(gone, "key").where("rid <> first").select(F.col("rid").alias(rid)), "gone")
    for old in (texts, one, crowds, sets, similar, groups):
        dropped(old)
    return numbered.join(gone, rid, "left_anti").select(*names)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
