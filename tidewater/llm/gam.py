"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow boosted trees, grown in turn on one feature at a time and then on pairs of features, add up to a lookup table
per feature and per pair; a document's score is the sum of the entries of its bins. Features are counts of a text's
characters, words and lines. The model is fitted on the driver from the features of at most SAMPLE labelled documents
(those whose ids hash lowest, so the same ones in any run).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, text_bytes, text_of

SAMPLE, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 8_000, 32, 8, 120, 40, 6, 0.15, 2.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "exclamations", "capitals", "distinct_words", "dup_lines", "distinct_pairs", "repeated_words", "digits", "bars", "stops", "longest_word", "lines")

_KINDS = {"symbols": b"#*$%&|<>", "exclamations": b"!?", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "bars": b"|", "stops": b".,;:", "lines": b"\n", "blanks": b" \t\n\x0b\f\r"}


def features(text: bytes) -> list[float]:
    """FEATURES of one whole text; of an empty one all are 0."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = {k: int(count[list(v)].sum()) for k, v in _KINDS.items()}
    letters = len(text) - of["blanks"]
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(w, w[1:], strict=False)))
    again = sum(map(bytes.__eq__, w, w[1:]))
    return [
        math.log1p(n), letters / n, of["symbols"] / n, of["exclamations"] / n, of["capitals"] / letters, len(set(w)) / n,
        1 - len(set(lines)) / len(lines), pairs / max(1, n - 1), again / n, of["digits"] / letters, of["bars"] / n, of["stops"] / n, math.log1p(max(map(len, w))), of["lines"] / n,
    ]


@dataclass
class Gam:
    """intercept, edges of each feature's bins, its table, and for pairs of features their coarse edges and table."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, ea, eb, table in self.pairs:
            out += table[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, int]:
    """(gain, place) of the best cut of a line of bins; place 0: none."""
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    gain = _gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch) - _gain(cg[-1:], ch[-1:])
    gain[(cn < least) | (cn[-1] - cn < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, depth: int = 2) -> np.ndarray:
    """A shallow tree over a line of bins, as a value per bin."""
    _, at = _split(g, h, n, least) if depth and len(g) > 1 else (0, 0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.r_[_tree(g[:at], h[:at], n[:at], least, depth - 1), _tree(g[at:], h[at:], n[at:], least, depth - 1)]


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> tuple[float, np.ndarray]:
    """One cut along either axis and one along the other on each side; gain and value per cell."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for at in range(1, len(a)):
            value, gain = np.empty(a.shape), -float(_gain(a.sum(), b.sum()))
            for part in (slice(0, at), slice(at, None)):
                lg, lh, ln = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                _, cut = _split(lg, lh, ln, least)
                for side in (slice(0, cut), slice(cut, None)):
                    if lg[side].size:
                        value[part, side] = -lg[side].sum() / (lh[side].sum() + RIDGE)
                        gain += float(_gain(lg[side].sum(), lh[side].sum()))
            if gain > best[0]:
                best = gain, value.T if turned else value
    return best


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    # a feature that is mostly one value still gets bins for the others
    rest = x[~np.isin(x, cuts)]
    return np.unique(np.r_[cuts, np.nextafter(cuts, np.inf), np.quantile(rest, np.linspace(0, 1, bins // 2)[1:-1]) if len(rest) else []])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Logistic loss, cyclic boosting. Without examples the model says 0.5; with one class only, its smoothed share."""
    model = Gam()
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return model
    least = max(5, len(y) // 500)
    for f in range(x.shape[1]):
        model.edges.append(_edges(x[:, f], BINS))
        model.tables.append(np.zeros(len(model.edges[f]) + 1))
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    raw = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    sizes = [np.bincount(a, minlength=len(t)) for a, t in zip(at, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for a, table, n in zip(at, model.tables, sizes, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(a, g, len(table)), np.bincount(a, h, len(table)), n, least)
            table += step
            raw += step[a]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cat = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)

    def cells(v, a, b):
        s = shape(a, b)
        return np.bincount(cat[a] * s[1] + cat[b], v, s[0] * s[1]).reshape(s)

    g, h = slopes()
    one = np.ones(len(y))
    strength = sorted(((_pair_tree(cells(g, a, b), cells(h, a, b), cells(one, a, b), least)[0], a, b) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros(shape(a, b))) for _, a, b in strength[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, _, _, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(cells(g, a, b), cells(h, a, b), cells(one, a, b), least)[1]
            table += step
            raw += step[cat[a], cat[b]]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `size` labelled documents: those of `train` (a condition) whose ids hash lowest.

    Of documents with the same id one is learned from, that whose text hashes lowest (a null text counts as empty); an
    id with several labels has the largest. Rows without an id or a label are none.
    """
    chosen = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # `size` bounds what is broadcast; a row per id bounds what is joined, and copies meet in a partial aggregate first
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_of(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, size: int = SAMPLE) -> Gam:
    """Learns `quality` from at most `size` labelled documents whose crc32 of the id as text is not divisible by `folds`.

    labelled_sample() says which. Other columns are ignored; without labels the model says 0.5 of everything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in text_bytes(b.column(2))], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = labelled_sample(docs, labels, "quality", fold_of("doc_id", folds) != 0, size).mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows.column("label").to_numpy().astype(float))


def classify(docs: DataFrame, model: Gam, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null and empty texts score as texts without words.

    Bytes that are no UTF-8 are counted as they are.
    Repeated rows and ids each have their own result; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array([features(t) for t in text_bytes(b.column(2))], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(model: Gam):
    """The score as a column function of a text column, for filters; a null text scores as an empty one.

    Bytes that are no UTF-8 must have been replaced (text_of()).
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(model.score(np.array([features((t or "").encode()) for t in s], float).reshape(-1, len(FEATURES))))

    return F.pandas_udf(run, "double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, train(docs, labels))
