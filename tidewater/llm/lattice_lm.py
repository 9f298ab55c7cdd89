"""Language-model scores by subword lattices.

A word's probability is the sum over all its segmentations into pieces of a public vocabulary, by a forward recursion
in log space; characters may also be spelt in the vocabulary's byte pieces, so no word is impossible. The vocabulary's
own scores are merge ranks rather than log-probabilities, so they give the prior (weight 1/(rank + 10)), and rounds of
expectation maximisation over every distinct training word, weighted by its count, turn that into piece probabilities;
they end when a round has raised the log-likelihood of the training text by no more than a thousandth.
A text is its words, each begun by the word mark, and an end; its probability is their product.

Words are counted over all documents. Documents then score their frequent words (a bounded table) on the spot and join
the others to the word table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold_of, stored, text_bytes

MARK = "▁"
#: Words whose scores travel to every task; entries that a task holds before it hands them on.
FREQUENT, HELD = 65_536, 400_000
#: Words, and bytes of words, that a worker takes on together; code points of one matrix.
TOGETHER, TOGETHER_BYTES, CODES = 100_000, 4 << 20, 1 << 19
#: Added to each piece's expected count; the additive constant of the base score.
PIECE_PRIOR, ADDED = 0.01, 0.1
#: Words longer than this are walked character by character, by so many characters at a time.
LONG, SPAN = 200, 1 << 15
#: Relative gain of log-likelihood at which the rounds of expectation maximisation end.
GAIN = 1e-3


@dataclass
class Vocabulary:
    """pieces: text -> number, the word mark only in front; byte_of: byte -> number; end: number of the end."""

    pieces: dict[str, int]
    byte_of: list[int]
    end: int
    prior: np.ndarray

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_of = {}, [0] * 256
        prior = np.full(len(model), 0.0)
        for i in range(len(model)):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_of[int(text[3:5], 16)] = i
                prior[i] = 1.0 / len(model)
            elif not model.is_control(i) and not model.is_unknown(i) and MARK not in text[1:] and text != MARK * len(text[:2]):
                pieces[text] = i
                prior[i] = 1.0 / (10.0 - model.get_score(i))
        pieces[MARK] = model.piece_to_id(MARK)
        prior[pieces[MARK]] = prior[pieces[MARK]] or 1.0 / (10.0 - model.get_score(pieces[MARK]))
        end = model.eos_id()
        prior[end] = prior.sum() * 0.01
        return cls(pieces, byte_of, end, prior / prior.sum())


class Lattice:
    """Scores many words at a time: words of equal length are one matrix of code points, walked down the piece trie."""

    def __init__(self, vocabulary: Vocabulary, prob: np.ndarray):
        self.v = vocabulary
        with np.errstate(divide="ignore"):
            self.logp = np.log(prob)
        edges: dict[tuple[int, int], int] = {}
        terminal = [-1]
        for text, number in vocabulary.pieces.items():
            node = 0
            for ch in map(ord, text):
                if (node, ch) not in edges:
                    edges[node, ch] = len(terminal)
                    terminal.append(-1)
                node = edges[node, ch]
            terminal[node] = number
        self.terminal = np.array(terminal)
        # transitions in an open-addressed table, so that a whole column of words takes a step at once
        self.mask = (1 << (len(edges) * 4).bit_length()) - 1
        self.slot_key, self.slot_to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        keys = np.array([(n << 21) | c for n, c in edges], np.int64)
        to = np.array(list(edges.values()), np.int64)
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            put = todo[free][np.unique(at[todo[free]], return_index=True)[1]]
            self.slot_key[at[put]], self.slot_to[at[put]] = keys[put], to[put]
            todo = todo[self.slot_key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.bytes_log: dict[int, float] = {}

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def _step(self, node: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """The child, or -1."""
        keys = (node << 21) | ch
        at = self._hash(keys)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            seen = self.slot_key[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.slot_to[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
            at[open_] = (at[open_] + 1) & self.mask
        return out

    def _spelt(self, chars: np.ndarray) -> np.ndarray:
        """Log-probability of each character in byte pieces."""
        known, where = np.unique(chars, return_inverse=True)
        for c in known.tolist():
            if c not in self.bytes_log:
                self.bytes_log[c] = float(sum(self.logp[self.v.byte_of[b]] for b in chr(c).encode("utf-8", "surrogatepass")))
        return np.array([self.bytes_log[c] for c in known.tolist()])[where]

    def forward(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """alpha[j]: log of the summed probability of all segmentations of the first j characters. keep: gets the arcs."""
        n, length = codes.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i in range(length):
            spelt = self._spelt(codes[:, i])
            alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i] + spelt)
            if keep is not None:
                keep.append((i, i + 1, np.arange(n), None, spelt))
            rows, node, j = np.arange(n), np.zeros(n, np.int64), i
            while len(rows) and j < length:
                node = self._step(node, codes[rows, j])
                rows, node, j = rows[node >= 0], node[node >= 0], j + 1
                piece = self.terminal[node]
                full = piece >= 0
                if full.any():
                    r, p = rows[full], piece[full]
                    alpha[j, r] = np.logaddexp(alpha[j, r], alpha[i, r] + self.logp[p])
                    if keep is not None:
                        keep.append((i, j, r, p, self.logp[p]))
        return alpha

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in words, code points with the mark in front), by length, at most CODES code points at a time; long words alone."""
        marked = [MARK + w.decode("utf-8", "surrogateescape") for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            step = max(1, CODES // length) if length <= LONG else 1
            for s in range(0, len(at), step):
                own = at[s : s + step]
                yield own, np.frombuffer("".join(marked[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(own), length)

    def arcs(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece, log-probability) of what begins at low to high - 1 of one word, by start; piece -1: a character in bytes."""
        at = np.arange(low, high)
        found = [(at, at + 1, np.full(len(at), -1), self._spelt(codes[low:high]))]
        node, end = np.zeros(len(at), np.int64), at
        while len(at):
            node = self._step(node, codes[end])
            at, node, end = at[node >= 0], node[node >= 0], end[node >= 0] + 1
            piece = self.terminal[node]
            full = piece >= 0
            found.append((at[full], end[full], piece[full], self.logp[piece[full]]))
            more = end < len(codes)
            at, node, end = at[more], node[more], end[more]
        start, end, piece, logp = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order], logp[order]

    def _forward_long(self, codes: np.ndarray) -> np.ndarray:
        """alpha of forward() for one word: eight bytes a character, and the arcs of a span of them."""
        alpha = np.full(len(codes) + 1, -np.inf)
        alpha[0] = 0
        for low in range(0, len(codes), SPAN):
            high = min(low + SPAN, len(codes))
            start, end, _, logp = self.arcs(codes, low, high)
            last = int(end.max())
            _sum_along(a := alpha[low : last + 1].tolist(), (start - low).tolist(), (end - low).tolist(), logp.tolist())
            alpha[low : last + 1] = a
        return alpha

    def _expected_long(self, codes: np.ndarray, weight: float, out: np.ndarray) -> float:
        """Adds one word's expected pieces to out; returns the log of its probability."""
        alpha, beta = self._forward_long(codes), np.full(len(codes) + 1, -np.inf)
        beta[-1] = 0
        for low in range((len(codes) - 1) // SPAN * SPAN, -1, -SPAN):
            start, end, piece, logp = self.arcs(codes, low, min(low + SPAN, len(codes)))
            last = int(end.max())
            _sum_along(b := beta[low : last + 1].tolist(), (end - low)[::-1].tolist(), (start - low)[::-1].tolist(), logp[::-1].tolist())
            beta[low : last + 1] = b
            share = weight * np.exp(alpha[start] + logp + beta[end] - alpha[-1])
            whole = piece >= 0
            out += np.bincount(piece[whole], share[whole], len(out))
            self._add_bytes(codes[start[~whole]], share[~whole], out)
        return float(alpha[-1])

    def _add_bytes(self, chars: np.ndarray, share: np.ndarray, out: np.ndarray) -> None:
        known, where = np.unique(chars, return_inverse=True)
        for c, x in zip(known.tolist(), np.bincount(where, share).tolist(), strict=True):
            for b in chr(c).encode("utf-8", "surrogatepass"):
                out[self.v.byte_of[b]] += x

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        out = np.zeros(len(words))
        for at, codes in self.groups(words):
            out[at] = self.forward(codes)[-1] if codes.shape[1] <= LONG else self._forward_long(codes[0])[-1]
        return out / math.log(10)

    def expected(self, words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected number of each piece in the words, over all segmentations, and the words' weighted log-likelihood."""
        out, likelihood = np.zeros(len(self.logp)), 0.0
        for at, codes in self.groups(words):
            if codes.shape[1] > LONG:
                likelihood += float(weights[at[0]]) * self._expected_long(codes[0], float(weights[at[0]]), out)
                continue
            arcs: list = []
            alpha = self.forward(codes, arcs)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0
            w, total = weights[at], alpha[-1]
            likelihood += float(w @ total)
            for i, j, r, p, lp in sorted(arcs, key=lambda a: -a[0]):
                beta[i, r] = np.logaddexp(beta[i, r], lp + beta[j, r])
                share = w[r] * np.exp(alpha[i, r] + lp + beta[j, r] - total[r])
                if p is not None:
                    out += np.bincount(p, share, len(out))
                else:
                    self._add_bytes(codes[:, i], share, out)
        return out, likelihood


def _sum_along(total: list[float], from_: list[int], to: list[int], logp: list[float]) -> None:
    """total[to] gets log(exp(total[to]) + exp(total[from_] + logp)), arc by arc."""
    exp, log1p, none = math.exp, math.log1p, -math.inf
    for i, j, lp in zip(from_, to, logp, strict=True):
        x, y = total[i] + lp, total[j]
        if y == none:
            total[j] = x
        elif x > y:
            total[j] = x + log1p(exp(y - x))
        elif x != none:
            total[j] = y + log1p(exp(x - y))


def _in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (word, ..) together, at most TOGETHER of them and, but for a longer word, TOGETHER_BYTES of words."""
    held, n, size = [], 0, 0
    for b in batches:
        each = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(each[at - 1]) if at else 0
            to = max(int(np.searchsorted(each, before + TOGETHER_BYTES - size, "right")), at + (not held))
            to = min(to, b.num_rows, at + TOGETHER - n)
            if to > at:
                held.append(b.slice(at, to - at))
                n, size, at = n + to - at, size + int(each[to - 1]) - before, to
            if at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of (text, held_out) and its count in the training documents."""

    def run(batches):
        count: Counter = Counter()

        def out():
            b = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])
            count.clear()
            return b

        for b in batches:
            for t, held in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                w = t.lower().split()
                if held:
                    for x in w:
                        count.setdefault(x, 0)
                else:
                    count.update(w)
                if len(count) > HELD:
                    yield out()
        yield out()

    return docs.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _scored(words: DataFrame, vocabulary: Vocabulary, prob: np.ndarray) -> DataFrame:
    """The words with their lattice scores."""

    def run(batches):
        lattice = Lattice(vocabulary, prob)
        for t in _in_chunks(batches):
            yield from t.append_column("lm", pa.array(lattice.scores(t.column("word").to_pylist()))).to_batches()

    return words.select("word", "c").mapInArrow(run, "word binary, c long, lm double")


def train(words: DataFrame, documents: int, vocabulary: Vocabulary, gain: float = GAIN) -> tuple[np.ndarray, list[float]]:
    """(piece probabilities, log-likelihood of the training text before each round).

    Expectation maximisation over all training words, ends included, a job over the words a round. No round lowers the
    likelihood, which has a bound, so that the relative gain falls to any limit in the end.
    """
    prob, likelihoods = vocabulary.prior, []
    while len(likelihoods) < 2 or likelihoods[-1] - likelihoods[-2] > gain * abs(likelihoods[-1]):
        count, likelihood = _expected(words, vocabulary, prob)
        likelihoods.append(likelihood + documents * float(np.log(prob[vocabulary.end])))
        prob = _maximised(count, documents, vocabulary)
    return prob, likelihoods


def _expected(words: DataFrame, vocabulary: Vocabulary, prob: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected number of each piece in all training words, and their log-likelihood."""

    def run(batches):
        lattice = Lattice(vocabulary, prob)
        total, likelihood = np.zeros(len(prob)), 0.0
        for t in _in_chunks(batches):
            count, like = lattice.expected(t.column("word").to_pylist(), t.column("c").to_numpy().astype(float))
            total += count
            likelihood += like
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], likelihood])], names=["piece", "x"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
    found = dict(zip(rows.column("piece").to_pylist(), rows.column("x").to_pylist(), strict=True))
    likelihood, count = found.pop(-1, 0.0), np.zeros(len(prob))
    count[list(found)] = list(found.values())
    return count, likelihood


def _maximised(count: np.ndarray, documents: int, vocabulary: Vocabulary) -> np.ndarray:
    """The probabilities that those counts and the ends make likeliest, with a small prior on each usable piece."""
    count = count.copy()
    count[vocabulary.end] += documents
    count[vocabulary.prior > 0] += PIECE_PRIOR
    return count / count.sum()


def score(docs: DataFrame, model_path: str, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows whose crc32 of the id as text is divisible by `folds` are held out; the others are trained on. Null and empty
    texts are just an end. Texts and words may be of any length; bytes that are no UTF-8 are spelt as they are. Repeated
    rows and ids each count and have their own result. Without training rows no token is known, every count is 0 and the
    base is uniform. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.from_model(model_path)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words = stored(word_counts(docs), "words")
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = docs.where(~F.col("held_out")).count()
    tokens, distinct = found[0] + ends, found[1] + (ends > 0)
    below = math.log10(tokens + ADDED * (distinct + 1))
    prob, _ = train(words, ends, vocabulary)
    scored = stored(_scored(words, vocabulary, prob), "scored")
    dropped(words)
    # what travels: frequent words of ordinary length, so that its size has a bound
    short = scored.where(F.octet_length("word") <= LONG).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow().to_pylist()
    known = spark.sparkContext.broadcast({r["word"]: (r["c"] > 0, math.log10(r["c"] + ADDED) - below, r["lm"]) for r in short})
    end_base, end_score = math.log10(ends + ADDED) - below, float(np.log10(prob[vocabulary.end]))
    types = {"rid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "lm": pa.float64(), "word": pa.binary(), "rids": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in types.items()], names=list(types))

    def run(batches):
        near = known.value
        rare: dict[bytes, tuple[list[int], list[int]]] = {}
        held = 0

        def handed_on() -> pa.RecordBatch:
            out = batch(len(rare), word=list(rare), rids=[x[0] for x in rare.values()], times=[x[1] for x in rare.values()])
            rare.clear()
            return out

        for b in batches:
            sums: list[tuple] = []
            rids = b.column(0).to_pylist()
            for rid, t in zip(rids, text_bytes(b.column(3)), strict=True):
                n, sure, base, lm = 1, int(ends > 0), end_base, end_score
                for w, m in Counter(t.lower().split()).items():
                    n += m
                    if (x := near.get(w)) is not None:
                        sure += m * x[0]
                        base += m * x[1]
                        lm += m * x[2]
                    else:
                        at = rare.setdefault(w, ([], []))
                        at[0].append(rid)
                        at[1].append(m)
                        held += 1
                sums.append((n, sure, base, lm))
                if held >= HELD:
                    yield handed_on()
                    held = 0
            yield batch(len(sums), rid=rids, doc_id=b.column(1), held_out=b.column(2), **{k: [x[i] for x in sums] for i, k in enumerate(("n", "known", "base", "lm"))})
        yield handed_on()

    schema = "rid long, doc_id long, held_out boolean, n long, known long, base double, lm double, word binary, rids array<long>, times array<long>"
    parts = stored(docs.select("rid", "doc_id", "held_out", "text").mapInArrow(run, schema), "parts")
    # a rare word travels once a task with the documents that have it, and meets its scores there
    rare = parts.where("word is not null").select("word", "rids", "times").join(scored, "word")
    rare = rare.select("c", F.col("lm").alias("lm1"), F.explode(F.arrays_zip("rids", "times")).alias("x")).select("c", "lm1", "x.rids", "x.times")
    rare = rare.groupBy(F.col("rids").alias("rid")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_"),
        F.sum(F.col("times") * (F.log10(F.col("c") + F.lit(ADDED)) - below)).alias("base_"),
        F.sum(F.col("times") * F.col("lm1")).alias("lm_"),
    )
    whole = parts.where("rid is not null").select("rid", "doc_id", "held_out", "n", "known", "base", "lm").join(rare, "rid", "left")
    return whole.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("known_", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_", F.lit(0.0))).alias("base_score"), (F.col("lm") + F.coalesce("lm_", F.lit(0.0))).alias("score"),
    )


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
