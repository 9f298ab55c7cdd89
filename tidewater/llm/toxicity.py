"""Toxicity by misspelling-tolerant lexicon look-up and context windows.

The lexicon (whole words and stems) is learned from labelled documents: first the terms that toxic documents have in too
many different surroundings, and clean ones hardly ever outside quotations, for chance; then, for documents that these leave unexplained,
the term found in most of them, again and again. Surroundings keep a copied document's rare words from counting as slurs. A Levenshtein
automaton of each term's tolerance, intersected with the lexicon's trie, is determinised as words come by: a word then
costs a table step per letter and most words die within a few. Hits close together are one context window; a hit in
quotation marks has a weight of its own, learned like that of misspelt ones. Windows combine by noisy-or.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fold_of, stored, text_of
from .gam import labelled_sample

#: Labelled documents that are learned from: at most so many. All terms that they tell are in the lexicon.
SAMPLE = 12_000
#: States of an automaton after which it begins anew; terms that a task counts before it hands them on.
STATES, HELD = 50_000, 400_000
#: A term is at least so many times as frequent among toxic documents, and explains at least this share of them.
RATIO, COVER = 30.0, 0.002
#: What counts as nearly as many; odds of a chance find.
NEARLY, CHANCE = 0.9, 1e-7
STEMS = range(4, 9)
#: Words between hits of one window; words before and after a hit that may open and close its quotation.
WINDOW, QUOTE = 8, 4
THRESHOLD = 0.3
OPENING, CLOSING = "\"'“„«‹‘‚”’", "\"'”“»›’‘"
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”„«»‹›‘’‚…–—¡¿"


def normal(token: str) -> str:
    return token.strip(_EDGES).lower()


def edits_of(term: str) -> int:
    """Tolerated edits by length: whole words none under four letters, one under nine, then two; stems one from five letters on."""
    n = len(term.rstrip("*"))
    return int(n >= 5) if term.endswith("*") else (n >= 4) + (n >= 9)


def is_loose(term: str) -> bool:
    """Whether words within the tolerated edits are mostly others: of stems and of short words."""
    return term.endswith("*") or len(term) < 5


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie, made deterministic state by state.

    look(word) gives (term, edits) of the nearest term, or None; of equally near ones that which is not loose, then the first. A term that ends in * is a stem: any ending may follow.
    The states are forgotten when there are STATES of them; what a word is found to be does not depend on that.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[dict[bool, str]] = [{}]
        self.most = [0]
        for t in sorted(terms):
            node, bound = 0, edits_of(t)
            self.most[0] = max(self.most[0], bound)
            for ch in t.rstrip("*"):
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.term.append({})
                    self.most.append(0)
                node = self.child[node][ch]
                self.most[node] = max(self.most[node], bound)
            self.term[node][t.endswith("*")] = t
        self._begin()

    def _begin(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], stem: tuple[int, str] | None) -> int:
        """Number of the state: trie nodes with their edits so far (skipped letters added), and the best stem passed."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            for m in self.child[n].values():
                if (e := nodes[n] + 1) <= self.most[m] and e < nodes.get(m, 99):
                    nodes[m] = e
                    todo.append(m)
        for n, e in nodes.items():
            t = self.term[n].get(True)
            if t and e <= edits_of(t) and (stem is None or (e, t) < stem):
                stem = (e, t)
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        nodes, stem = self.states[state]
        out: dict[int, int] = {}
        for n, e in nodes:
            if e + 1 <= self.most[n]:
                out[n] = min(out.get(n, 99), e + 1)  # a letter too many
            for c, m in self.child[n].items():
                cost = e + (c != ch)
                if cost <= self.most[m]:
                    out[m] = min(out.get(m, 99), cost)
        self.steps[state][ch] = to = self._state(out, stem)
        return to

    def look(self, word: str) -> tuple[str, int] | None:
        if len(self.states) >= STATES:
            self._begin()
        s = self.start
        for ch in word:
            to = self.steps[s].get(ch)
            s = self._step(s, ch) if to is None else to
            if not self.states[s][0]:
                break
        nodes, stem = self.states[s]
        best = stem
        if nodes or not word:
            for n, e in nodes:
                t = self.term[n].get(False)
                # of equally near terms a whole word comes before a stem
                if t and e <= edits_of(t) and (best is None or (e, is_loose(t), t) < (best[0], is_loose(best[1]), best[1])):
                    best = (e, t)
        return (best[1], best[0]) if best else None


def in_quotation(tokens: list[str], i: int) -> bool:
    """Whether a quotation opens at or before the token and closes at or after it, within QUOTE tokens each way."""
    opened = any(x[0] in OPENING for x in tokens[max(0, i - QUOTE) : i + 1])
    closed = any(x.rstrip(".,;:!?")[-1:] and x.rstrip(".,;:!?")[-1] in CLOSING for x in tokens[i : i + QUOTE + 1])
    return opened and closed


@dataclass(frozen=True)
class Hit:
    place: int
    term: str
    edits: int
    quoted: bool

    @property
    def kind(self) -> str:
        return ("exact" if not self.edits else "loose" if is_loose(self.term) else "misspelt") + ("_quoted" if self.quoted else "")


class Finder:
    """Hits of a text; words are remembered (a bounded number of them)."""

    KEPT = 500_000

    def __init__(self, terms: list[str]):
        self.automaton, self.seen = Automaton(terms), {}

    def _look(self, token: str):
        found = self.automaton.look(normal(token)) if self.automaton.states else None
        if len(token) <= 64:
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            self.seen[token] = found
        return found

    def hits(self, text: str) -> list[Hit]:
        tokens, seen = text.split(), self.seen
        out = []
        for i, t in enumerate(tokens):
            found = seen[t] if t in seen else self._look(t)
            if found:
                out.append(Hit(i, found[0], found[1], in_quotation(tokens, i)))
        return out


#: Share of abuse taken for granted in hits of a kind before any is seen, worth one document of evidence a term.
PRIOR = {"exact": 0.9, "misspelt": 0.5, "loose": 0.1, "exact_quoted": 0.6, "misspelt_quoted": 0.3, "loose_quoted": 0.05}


@dataclass
class Model:
    """terms; share of toxic documents among those with a hit of a term and kind; share among all, and among those without hits."""

    terms: list[str] = field(default_factory=list)
    share: dict[tuple[str, str], float] = field(default_factory=dict)
    toxic: float = 0.0
    base: float = 0.05

    def weight(self, h: Hit) -> float:
        """What a hit tells beyond how common toxic documents are anyway."""
        return max(0.0, (self.share.get((h.term, h.kind), PRIOR[h.kind]) - self.toxic) / (1 - self.toxic))

    def score(self, hits: list[Hit]) -> float:
        """1 - (1 - base) * product over windows of (1 - the strongest hit of the window)."""
        clean, last, best = 1 - self.base, None, 0.0
        for h in hits:
            if last is not None and h.place - last > WINDOW:
                clean *= 1 - best
                best = 0.0
            best, last = max(best, self.weight(h)), h.place
        return 1 - clean * (1 - best)


def _terms_of(text: str, unquoted: bool = False) -> dict[str, int]:
    """Terms of a text, whole words and stems, each with a hash of the words around its first place (unquoted: outside quotations)."""
    tokens, out = text.split(), {}
    words, done = list(map(normal, tokens)), set()
    for i, w in enumerate(words):
        if w and w not in done and not (unquoted and in_quotation(tokens, i)):
            done.add(w)
            around = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
            for t in ([w] if len(w) >= 3 else []) + [w[:n] + "*" for n in STEMS if len(w) > n]:
                out.setdefault(t, around)
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """(term, n, clean): in how many different surroundings toxic documents have each term, so that copies of one passage
    count once, and how many clean documents have it outside quotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter = Counter()

        def rows(terms, around, n):
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(around, pa.int64()), pa.array(n, pa.int64())], names=["term", "around", "clean"])

        for b in batches:
            pairs = set()
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if label:
                    pairs.update(_terms_of(text or "").items())
                else:
                    clean.update(_terms_of(text or "", unquoted=True).keys())
                if len(clean) >= HELD:
                    yield rows(list(clean), [None] * len(clean), list(clean.values()))
                    clean.clear()
            yield rows([p[0] for p in pairs], [p[1] for p in pairs], [0] * len(pairs))
        yield rows(list(clean), [None] * len(clean), list(clean.values()))

    found = sample.select("label", "text").mapInArrow(run, "term string, around long, clean long")
    return found.groupBy("term", "around").agg(F.sum("clean").alias("clean")).groupBy("term").agg(F.count("around").alias("n"), F.sum("clean").alias("clean"))


def _leanest(support: dict[str, int]) -> list[str]:
    """Without stems that a longer term stands for nearly as often, and without terms that begin with a stem that is left."""
    longer: dict[str, int] = {}
    for t, n in support.items():
        whole = t.rstrip("*")
        for k in STEMS:
            if k < len(whole) or k == len(whole) and not t.endswith("*"):
                longer[whole[:k] + "*"] = max(longer.get(whole[:k] + "*", 0), n)
    left = {t for t, n in support.items() if not (t.endswith("*") and longer.get(t, 0) >= NEARLY * n)}
    return sorted(t for t in left if not any(t.rstrip("*")[:k] + "*" in left - {t} for k in STEMS if k <= len(t.rstrip("*"))))


def _cover(documents: list[set[str]], least: int) -> list[str]:
    """Greedy: the term of most unexplained documents; of those nearly as good a whole word, then the longest stem."""
    left, out = documents, []
    while left:
        count = Counter(t for d in left for t in d)
        if not count:
            break
        most = max(count.values())
        if most < least:
            break
        best = max((t for t in count if count[t] >= NEARLY * most), key=lambda t: (not t.endswith("*"), len(t), t))
        out.append(best)
        left = [d for d in left if best not in d]
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, size: int = SAMPLE) -> Model:
    """Learns `toxic` from at most `size` labelled documents whose crc32 of the id as text modulo folds is not `held`.

    labelled_sample() says which; null texts are empty, labels without an id or a value are none, and other columns are
    ignored. Without toxic documents there are no terms, and without any documents the score is 0.05 for all.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", fold_of("doc_id", folds) != held, size), "sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = Model()
    if toxic:
        least = max(2, round(COVER * toxic))
        rates = F.col("n") / toxic >= RATIO * (F.col("clean") + 0.5) / (clean + 1)
        telling = {r["term"]: r["n"] for r in _counted(sample).where((F.col("n") >= least) & rates).collect()}  # of the sample's terms
        # so many surroundings that no term of the sample would have them in toxic documents alone by chance
        sure = math.log(CHANCE) / math.log(min(0.5, (toxic + 1) / (toxic + clean + 2)))
        model.terms = _leanest({t: n for t, n in telling.items() if n >= sure})
        wanted, sure_terms = frozenset(telling), frozenset(model.terms)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sorted(wanted.intersection(_terms_of(t or ""))) for t in b.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

        found = [set(r["terms"]) for r in sample.where("label = 1").select("text").mapInArrow(run, "terms array<string>").collect()]
        model.terms += _cover([d for d in found if not d & sure_terms], least)
    terms = model.terms

    def kinds(batches):
        finder, count = Finder(terms), Counter()
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {(h.term, h.kind) for h in finder.hits(text or "")}
                plain = {k for k in found if k[1].startswith("exact")}  # these explain the document; others are judged without them
                count.update((*k, label) for k in plain or found or {("", "none")})
        keys = list(count)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(2)), pa.array([k[2] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())], names=["term", "kind", "toxic", "df"])

    counted = sample.select("label", "text").mapInArrow(kinds, "term string, kind string, toxic int, df long").groupBy("term", "kind", "toxic").agg(F.sum("df").alias("df"))
    seen = {(r["term"], r["kind"], r["toxic"]): r["df"] for r in counted.collect()}  # a row per term, kind and label
    model.toxic = toxic / (toxic + clean + 1)
    for term, kind in {k[:2] for k in seen if k[1] != "none"}:
        t, f = seen.get((term, kind, 1), 0), seen.get((term, kind, 0), 0)
        model.share[term, kind] = (t + PRIOR[kind]) / (t + f + 1)
    t, f = seen.get(("", "none", 1), 0), seen.get(("", "none", 0), 0)
    model.base = (t + 0.05) / (t + f + 1)
    dropped(sample)
    return model


def classify(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, hits) of every whole text; hits: (place, term, edits, quoted) of each.

    Null and empty texts have no hits. Bytes that are no UTF-8 count as U+FFFD. Repeated rows and ids each have their own
    result; other columns are ignored; an empty table gives an empty result.
    """
    hit = pa.struct([("place", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.terms)
        for b in batches:
            found = [finder.hits(t or "") for t in b.column(2).to_pylist()]
            s = [model.score(h) for h in found]
            rows = [[{"place": h.place, "term": h.term, "edits": h.edits, "quoted": h.quoted} for h in hs] for hs in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array(rows, pa.list_(hit))], names=["doc_id", "held_out", "score", "predicted", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, folds) == held).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits array<struct<place:int,term:string,edits:int,quoted:boolean>>")


def abuse(model: Model):
    """The score as a column function of a text column, for filters; a null text scores as an empty one.

    Bytes that are no UTF-8 must have been replaced (text_of()).
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(model.terms)
        for s in texts:
            yield pd.Series([model.score(finder.hits(t or "")) for t in s], dtype="float64")

    return F.pandas_udf(run, "double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted", F.size("hits").alias("n_hits"))
