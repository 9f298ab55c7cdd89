import tracemalloc

import numpy as np
import pytest
import xxhash

from tidewater.llm import simhash
from tidewater.llm.common import components


def slow_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    ids = list(range(len(rows)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def result(spark, rows, schema="doc_id long, text string"):
    out = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Ünï", "x" * 50]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocab, rng.integers(1, 200)))
        rows.append((i * 3, " ".join(base)))
        for _ in range(3):
            near = list(base)
            for _ in range(rng.integers(0, 3)):
                near[rng.integers(len(near))] = "zz"
            rows.append((int(rng.integers(1000)), " \n".join(near).upper() if i % 2 else "\t".join(near)))
    rows += [(7, None), (8, ""), (8, " \n"), (None, "lonely text without any id at all"), (None, rows[0][1]), (5, "w1 w2"), (5, "w1 w2")]
    assert result(spark, rows) == slow_components(rows)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e", 1, 2), (2, "A b c d e", 1, 2)], "doc_id long, text string, fp long, component_id long")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1}


@pytest.mark.parametrize("parts", [4, 5, 6])
def test_allocation_finds_every_pair_within_the_radius(parts):
    rng = np.random.default_rng(parts)
    fp = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = fp[:1500].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    groups = simhash.group_bits(len(fp), bits.T @ bits, parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = [np.bincount(simhash.values(np.r_[fp, near][:, None], g), minlength=1 << len(g)) for g in groups]
    _, ts = simhash.allocate(counts, 4)
    assert sum(t + 1 for t in ts) == 5
    apart = np.stack([np.bitwise_count(simhash.values(fp[:1500, None], g) ^ simhash.values(near[:, None], g)) for g in groups])
    assert (apart <= np.array(ts)[:, None]).any(axis=0).all()


def test_large_bucket_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(i, f"one two three four five six seven eight nine ten {'x' * (i % 40)}") for i in range(80)]
    assert result(spark, rows) == slow_components(rows)


def test_wide_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        base = [f"t{x}" for x in rng.integers(0, 5000, 120)]
        for k in range(4):
            near = list(base)
            for _ in range(2 * k):
                near[rng.integers(len(near))] = f"e{rng.integers(999)}"
            rows.append((4 * i + k, " ".join(near)))
    fps = [simhash.fingerprint(t.encode(), 5, 2) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= 25:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min(d for (d, _), q in zip(rows, root, strict=True) if q == r) for r in root}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, radius=25, halves=2).collect()}
    assert got == {d: least[r] for (d, _), r in zip(rows, root, strict=True)}
    assert 40 <= len(set(got.values())) < 160


def joined(n, i, j):
    """The parts that links make of 0..n-1, each named by its least member."""
    root = list(range(n))
    for a, b in zip(i, j, strict=True):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    return root


def test_equal_first_halves_with_different_second_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        first, second = int(rng.integers(3)) * 0x0F0F0F0F0F0F, int(rng.integers(4)) * 0x3333333333
        for _ in range(int(rng.integers(4))):
            second ^= 1 << int(rng.integers(60))
        rows.append((i, first, second))
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long, fp2 long"))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sum((a ^ b).bit_count() for a, b in zip(rows[i][1:], rows[j][1:], strict=True)) <= 4]
    want = joined(len(rows), *zip(*pairs, strict=True))
    got = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), radius=4, halves=2).collect()
    assert sorted((r.doc_id, r.fp, r.fp2, r.component_id) for r in got) == [(*r, w) for r, w in zip(rows, want, strict=True)]
    assert len({r[1] for r in rows}) == 3 < len(set(want)) < len(rows)


@pytest.mark.parametrize("blocks", [1, 2])
@pytest.mark.parametrize("sized", [False, True])
def test_parts_are_those_of_all_pairs(sized, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 16)
    monkeypatch.setattr(simhash, "COLUMNS", 50)
    rng = np.random.default_rng(7)
    fp = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)[rng.integers(0, 40, 300)]
    for _ in range(6):
        fp[np.arange(300), rng.integers(0, 2, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    size = np.r_[np.sort(rng.integers(100, 200, 180)), np.sort(rng.integers(100, 200, 120))]
    side = rng.integers(0, blocks, 300)
    before, after = simhash.parts_of(fp, 180, 9, side, size if sized else None, 0.8)
    near = [(a, b) for a in range(180) for b in range(a + 1, 300) if int(simhash.apart(fp[a], fp[b])) <= 9]
    must = [(a, b) for a, b in near if not sized or min(size[a], size[b]) >= 0.8 * max(size[a], size[b])]
    assert all(after[a] == after[b] for a, b in must) and all(before[a] == before[b] for a, b in must if blocks == 2 and side[a] == side[b])
    parts = joined(300, *zip(*near, strict=True))
    assert all(len({parts[i] for i in np.flatnonzero(after == x)}) == 1 for x in set(after.tolist()))
    if blocks == 1:
        assert before.tolist() == list(range(300))
    # the links, and those of single blocks, make the whole
    node = rng.permutation(300) * 10
    a, b = simhash.stars(node, before, after)
    at = {x: i for i, x in enumerate(node.tolist())}
    inside = [(x, y) for x in range(300) for y in range(x) if before[x] == before[y]]
    links = [(at[x], at[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)] + inside
    got = joined(300, *zip(*links, strict=True))
    assert all((got[x] == got[y]) == (after[x] == after[y]) for x in range(300) for y in range(x)) and len(a) == len(set(before.tolist())) - len(set(after.tolist()))


def test_dense_bucket_in_bounded_memory():
    fp = np.full((12_000, 1), 12345, np.uint64)
    fp[:, 0] ^= np.uint64(1) << np.arange(12_000, dtype=np.uint64) % np.uint64(64)
    tracemalloc.start()
    before, after = simhash.parts_of(fp, len(fp), 4, np.arange(12_000) % 2)
    links = simhash.stars(np.arange(12_000), before, after)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(after.tolist())) == 1 and len(links) == 1 and most < 200e6  # all pairs would take 1,152 MB


def test_very_long_text(spark):
    """Beyond the slices that shingles are hashed in."""
    words = [f"w{i % 997}x{i % 89}" for i in range(140_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:70_000], "other", *words[70_000:]])), (3, "short")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].fp % 2**64 == slow_fingerprint(rows[0][1]) and (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)


@pytest.mark.parametrize(
    "edges",
    [
        [],
        [(1, 1)],
        [(2, 1), (1, 2), (1, 2)],
        [(90, i) for i in range(80)],
        [(i, i + 1) for i in range(60)],
        [(i, 100 + i * 7 % 60) for i in range(60)] + [(100 + i, i + 1) for i in range(0, 60, 2)],
    ],
)
def test_components_against_union(spark, edges):
    """No edges, loops and repeats, a hub that is not the least node, a chain, and chains of both."""
    part: dict[int, set[int]] = {}
    for a, b in (e for e in edges if e[0] != e[1]):
        whole = part.get(a, {a}) | part.get(b, {b})
        part |= dict.fromkeys(whole, whole)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == sorted((n, min(whole)) for n, whole in part.items())


def handed_on(spark, monkeypatch, copies):
    """Rows of links that the near-dedup stage hands on for so many near copies of one text beside 60 others, and what stays."""
    rng = np.random.default_rng(5)
    base = [f"b{x}" for x in rng.integers(0, 9000, 300)]
    texts = [" ".join(f"o{x}" for x in rng.integers(0, 9000, 200)) for _ in range(60)]
    for i in range(copies):
        near = list(base)
        for x in rng.choice(300, 3, replace=False):
            near[x] = f"e{i}x{x}"
        texts.append(" ".join(near))
    rows, plain = [], simhash.stored

    def spy(df, what):
        out = plain(df, what)
        rows.append(out.count() if what == "links" else 0)
        return out

    monkeypatch.setattr(simhash, "stored", spy)
    left = simhash.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    monkeypatch.setattr(simhash, "stored", plain)
    return sum(rows), sorted(r.doc_id for r in left)


def test_near_copies_hand_on_few_links(spark, monkeypatch):
    """Not a link per copy and partition, and in proportion to the copies."""
    some, left = handed_on(spark, monkeypatch, 150)
    more, also = handed_on(spark, monkeypatch, 600)
    assert left == also == list(range(61))
    assert some <= 8 * 150 and more <= 8 * 600


@pytest.mark.parametrize("block", [8, 100, 65_536])
def test_crowds_are_those_of_all_pairs(spark, monkeypatch, block):
    """One bucket after another in many cells, of two blocks or one, small and large, whose rows the first partitions named alike."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK_MOST", block)
    monkeypatch.setattr(simhash, "STRIP", 16)
    rng = np.random.default_rng(11)
    fp = rng.integers(0, 2**64, (12, 2), dtype=np.uint64)[rng.integers(0, 12, 400)]
    for _ in range(14):
        fp[np.arange(400), rng.integers(0, 2, 400)] ^= np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)
    rows = [(*f, i, 100) for i, f in enumerate(np.unique(fp, axis=0).view(np.int64).tolist())]
    bits = np.array([r[:2] for r in rows], np.int64).view(np.uint64)
    i, j = np.nonzero(np.triu(simhash.apart(bits[:, None], bits[None]) <= 20, 1))
    want = joined(len(rows), i.tolist(), j.tolist())
    found = simhash._crowds(spark.createDataFrame(rows, "fp long, fp2 long, node long, size long"), 20, 2, 0.8).collect()
    assert {r.node: r.root for r in found} == {x: want[x] for x in np.union1d(i, j).tolist()} and len(found) > 30 and len({r.root for r in found}) > 3
