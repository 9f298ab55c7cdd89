"""The pipeline's stages against plain versions of them on a small table."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tidewater.llm import gam, mixing, simhash, toxicity
from tidewater.llm.common import stored


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_near_dedup(texts):
    """Roots of the groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by all pairs."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def plain_words(text):
    return (text or "").encode().split()


def test_stages_against_plain_versions(spark, sf):
    (_, toxic), (_, quality), (_, near), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")

    kept = stored(toxic(spark, docs, sf), "a")
    model = toxicity.train(docs, labels)
    finder = toxicity.Finder(model.terms)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in docs.collect() if model.score(finder.hits(r.text)) < 0.3)

    good = stored(quality(spark, kept, sf), "b")
    gm = gam.train(kept, labels)
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in kept.collect() if gm.score(np.array([gam.features(r.text.encode())]))[0] >= 0.3)

    one = stored(near(spark, good, sf), "c")
    rows = good.collect()
    root = plain_near_dedup([r.text for r in rows])
    left = {r.doc_id for r in one.collect()}
    by = defaultdict(list)
    for r, q in zip(rows, root, strict=True):
        by[q].append(r.doc_id)
    assert one.count() == len(set(root)) and all(len(left & set(x)) == 1 for x in by.values())

    mix = stored(mixed(spark, one, sf), "d")
    size, took = Counter(), Counter()
    text = {r.doc_id: r for r in one.collect()}
    for r in text.values():
        size[r.source] += len(plain_words(r.text))
    per = Counter()
    for r in mix.collect():
        took[r.source] += len(plain_words(r.text))
        per[r.doc_id] += len(plain_words(r.text))
        assert not Counter(plain_words(r.text)) - Counter(plain_words(text[r.doc_id].text)) and r.n_chars == len(r.text)
    names = sorted(size)
    for s, goal in zip(names, mixing.targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True):
        assert abs(took[s] - goal) <= 0.5
    assert all(n <= 2 * len(plain_words(text[d].text)) for d, n in per.items())

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in mix.collect():
        ids = np.array(theirs.encode_ordinary(r.text), "<u4").tobytes()
        want[r.doc_id, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in encoded(spark, mix, sf).collect()) == want
    # run() is the same stages in turn
    assert Counter(r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()) == Counter({k[3]: n for k, n in want.items()})


def test_one_of_each_group_stays(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(4, text), (2, text), (2, text), (None, text), (9, "quite another text of some six words"), (None, None), (None, None), (7, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = [r.text for r in simhash.one_of_each_group(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert sorted(kept, key=str) == sorted([text, rows[4][1], None, "short"], key=str)


def test_null_columns_and_empty_table(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.limit(30).unionAll(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0)], docs.schema))
    for name, df in (("some", some), ("none", docs.limit(0))):
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        for _, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, sf), "x")
        assert df.columns[0] == "doc_id" and (name == "some") == (df.count() > 0)


def test_near_dedup_goes_by_shingle_similarity(spark, tmp_path):
    """Fingerprints may be near; only a Jaccard similarity of at least 0.8 counts."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(24):
        base = [f"w{x}" for x in rng.integers(0, 10_000, 150)]
        for changed in (0, 1, 3, 7, 12):  # a changed word is in five shingles
            near = list(base)
            for at in rng.choice(150, changed, replace=False):
                near[at] = f"n{rng.integers(10_000)}"
            rows.append((len(rows), " ".join(near)))
    rows += [(900 + i, "one very short text" + " and more" * (i % 3)) for i in range(4)]
    root = plain_near_dedup([t for _, t in rows])
    fps = [simhash.fingerprint(t.encode(), 5, 2) for _, t in rows]
    assert any(root[i] != root[j] and sum((x ^ y).bit_count() for x, y in zip(fps[i], fps[j], strict=True)) <= 25 for i in range(len(rows)) for j in range(i))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = [r.doc_id for r in simhash.one_of_each_group(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert sorted(kept) == [rows[i][0] for i in sorted(set(root))]


def test_columns_that_clash(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 5, 6, "a", 0, 0), (2, text, 5, 6, "a", 0, 0), (3, "two words", 7, 8, None, 0, 0)], "doc_id long, text string, rid long, key int, root string, `size` int, node long").coalesce(1)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [tuple(r) for r in docs.collect() if r.doc_id != 2]


def test_sets_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "SETS", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(30)] + [(99, " ".join(base[::-1]))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in simhash.one_of_each_group(spark.read.parquet(str(tmp_path / "d"))).collect()) == [0, 99]


def turned_about(spark, rows, schema, folder):
    """A table whose rows come in the opposite order each time it is read again."""

    def run(batches):
        for b in batches:
            n = len(list(folder.iterdir()))
            (folder / str(n)).touch()
            yield b.take(list(range(b.num_rows))[:: -1 if n % 2 else 1])

    return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(run, schema)


def test_rows_in_another_order_when_read_again(spark, tmp_path):
    folder = tmp_path / "dedup"
    folder.mkdir()
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    rows = [(i, texts[i]) for i in (0, 1, 2, 3)] + [(9, texts[0]), (8, texts[0])]
    kept = simhash.one_of_each_group(turned_about(spark, rows, "doc_id long, text string", folder)).collect()
    assert sorted(r.text for r in kept) == texts

    folder = tmp_path / "mix"
    folder.mkdir()
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(3 + 40 * i)), "ab"[i % 2]) for i in range(8)]
    docs = turned_about(spark, rows, "doc_id long, text string, source string", folder)
    size = Counter({x: sum(3 + 40 * i for i in range(8) if "ab"[i % 2] == x) for x in "ab"})
    goal = mixing.targets([size["a"], size["b"]], list(mixing.WEIGHTS[:2]))
    took = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert set(r.text.split()) <= set(rows[r.doc_id][1].split())
        took[r.source] += len(r.text.split())
    assert all(abs(took[s] - g) <= 0.5 for s, g in zip("ab", goal, strict=True))
